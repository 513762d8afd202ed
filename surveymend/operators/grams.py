"""An index of street names for fuzzy search: postings of numbered letters and of words, with prefix and length filters.

A name's grams are its letters, each with its number among equal letters, in the order of their rarity. Texts that share no
word are alike only if they have enough letters in common, how many following from the cutoff and both lengths; so of two
such texts the rarest grams, as many as may be missing and one more, have one in common. A query visits the postings of its
own rarest grams, then letters are counted, and the longest common subsequence of what is left is computed for all pairs at
once, bit by bit. Texts that share a word are found by the postings of words; odd ones are always candidates.

The bounds are those of ``match.weighted_ratio``, so no pair that reaches the cutoff is lost. ``seen`` counts pairs after
each step.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np

#: Letters of a text that bit rows hold; longer texts are always candidates. Pairs that are compared at once.
BITS, PAIRS = 64, 1 << 19


def scale(longer: float) -> float | None:
    """The weight of partial similarity by the ratio of lengths; none where texts are nearly as long as each other."""
    return None if longer < 1.5 else 0.6 if longer > 8 else 0.9


def reach(common: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The most that whole and partial measures give texts of lengths n and m that share no word, by their letters in common."""
    longer = np.maximum(n, m) / np.maximum(np.minimum(n, m), 1)
    whole = 200.0 * common / np.maximum(n + m, 1)
    part = np.where(longer > 8, 0.6, 0.9) * 200.0 * common / np.maximum(np.minimum(n, m) + common, 1)
    return whole, np.where(longer < 1.5, 0.0, part)


def least_common(n: int, m: int, cutoff: float) -> int:
    """Letters that texts of these lengths have in common if they share no word and reach the cutoff."""
    need = cutoff * (n + m) / 200
    weight = scale(max(n, m) / min(n, m))
    if weight is not None and 200 * weight > cutoff:
        need = min(need, cutoff * min(n, m) / (200 * weight - cutoff))
    return math.ceil(need - 1e-9)


def numbered(text: str) -> list[tuple[str, int]]:
    have: Counter = Counter()
    out = []
    for c in text:
        have[c] += 1
        out.append((c, have[c]))
    return out


def by_words(text: str) -> str:
    return " ".join(sorted(text.split()))


def odd(text: str) -> bool:
    """Whether a text repeats a word, which measures count once, or has spaces that its words in order don't have."""
    words = text.split()
    return len(set(words)) < len(words) or " ".join(words) != text


class Names:
    """A part of the names and its postings."""

    def __init__(self, names: list[str]):
        self.names = names
        self.seen: Counter = Counter()
        self.size = np.array([len(n) for n in names], np.int64)
        grams = [numbered(n) for n in names]
        often = Counter(g for gs in grams for g in gs)
        #: Grams from the rarest on; those of queries that no name has come first.
        self.rank = {g: k for k, g in enumerate(sorted(often, key=lambda g: (often[g], g)))}
        self.letters = {c: k + 1 for k, c in enumerate(sorted({c for n in names for c in n}))}
        lists: list[list[tuple[int, int]]] = [[] for _ in self.rank]
        for k, gs in enumerate(grams):
            for at, g in enumerate(sorted(map(self.rank.__getitem__, gs))):
                lists[g].append((k, at))
        #: For each gram, the names that have it and its place among their grams.
        self.postings = [np.array(x, np.int64).reshape(-1, 2) for x in lists]
        self.words: dict[str, list[int]] = {}
        for k, n in enumerate(names):
            for w in set(n.split()):
                self.words.setdefault(w, []).append(k)
        self.odd = np.array([k for k, n in enumerate(names) if odd(n)], np.int64)
        self.long = self.size > BITS
        self.several = np.array([" " in n for n in names], bool)
        self.counts = np.zeros((len(names), len(self.letters) + 1), np.int16)
        for k, n in enumerate(names):
            for c in n:
                self.counts[k, self.letters[c]] += 1
        self.codes, self.codes_back, self.codes_by_words = self._codes(names), self._codes([n[::-1] for n in names]), self._codes([by_words(n) for n in names])
        self._least: dict[tuple[int, float], np.ndarray] = {}

    def _codes(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), min(max([0, *map(len, texts)]), BITS)), np.int32)
        for k, t in enumerate(texts):
            if len(t) <= BITS:
                out[k, : len(t)] = [self.letters.get(c, 0) for c in t]
        return out

    def _need(self, n: int, cutoff: float) -> np.ndarray:
        """Letters in common that each length of names needs, for queries of n letters."""
        if (n, cutoff) not in self._least:
            self._least[n, cutoff] = np.array([least_common(n, m, cutoff) if m else n + 1 for m in range(int(self.size.max(initial=0)) + 1)])
        return self._least[n, cutoff]

    def _by_words(self, q: str, cutoff: float) -> np.ndarray:
        """Names that share a word, or are odd, and aren't too long or short for any measure."""
        some = np.unique(np.concatenate([self.odd, *(np.array(self.words.get(w, []), np.int64) for w in set(q.split()))]))
        longer = np.maximum(self.size[some], len(q)) / np.maximum(np.minimum(self.size[some], len(q)), 1)
        # Beyond 8 times the length no part weighs more than 60, and whole texts have 2/9 in common.
        return some[longer <= 8] if cutoff > 60 else some

    def _by_grams(self, q: str, cutoff: float) -> np.ndarray:
        grams = sorted(self.rank.get(g, -1) for g in numbered(q))
        need = self._need(len(q), cutoff)
        reachable = need[(need <= len(q)) & (need <= np.arange(len(need)))]
        if not len(reachable):
            return np.zeros(0, np.int64)
        out = []
        for at, g in enumerate(grams[: len(q) - int(reachable.min()) + 1]):
            if g >= 0:
                who, place = self.postings[g].T
                least = need[self.size[who]]
                out.append(who[(at <= len(q) - least) & (place <= self.size[who] - least)])
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)

    def pairs(self, queries: list[str], cutoff: float) -> tuple[np.ndarray, np.ndarray]:
        """(query, name) of all pairs that may reach the cutoff, by query and name."""
        sure, maybe = [], []
        for q in queries:
            if not q or odd(q) or cutoff <= 0:
                sure.append(np.arange(len(self.names)) if q else np.zeros(0, np.int64))
                maybe.append(np.zeros(0, np.int64))
                continue
            mine = self._by_words(q, cutoff)
            sure.append(mine)
            maybe.append(np.setdiff1d(self._by_grams(q, cutoff), mine, assume_unique=True))
        self.seen.update(all=len(queries) * len(self.names), words=sum(map(len, sure)), grams=sum(map(len, maybe)))
        who, name = np.repeat(np.arange(len(queries)), [len(x) for x in maybe]), np.concatenate([np.zeros(0, np.int64), *maybe])
        keep = np.concatenate([np.zeros(0, bool), *(self._reach(queries, who[lo : lo + PAIRS], name[lo : lo + PAIRS], cutoff) for lo in range(0, len(who), PAIRS))])
        who = np.concatenate([np.repeat(np.arange(len(queries)), [len(x) for x in sure]), who[keep]])
        name = np.concatenate([np.zeros(0, np.int64), *sure, name[keep]])
        order = np.lexsort((name, who))
        self.seen.update(candidates=len(order))
        return who[order], name[order]

    def possible(self, q: str, cutoff: float) -> np.ndarray:
        return self.pairs([q], cutoff)[1]

    def _reach(self, queries: list[str], who: np.ndarray, name: np.ndarray, cutoff: float) -> np.ndarray:
        """Which pairs, without a shared word, have enough letters in common, and in the same order."""
        n, m = np.array([len(q) for q in queries])[who], self.size[name]
        counts = np.zeros((len(queries), self.counts.shape[1]), np.int16)
        for k, q in enumerate(queries):
            for c in q:
                counts[k, self.letters.get(c, 0)] += 1
        counts[:, 0] = 0
        common = np.minimum(counts[who], self.counts[name]).sum(axis=1)
        keep = np.maximum(*reach(common, n, m)) >= cutoff - 1e-9
        self.seen.update(counted=int(keep.sum()))
        some = np.flatnonzero(keep & (n <= BITS) & ~self.long[name])
        own = self._common(queries, who[some], self.codes[name[some]])
        whole, part = reach(own, n[some], m[some])
        # A part is as long as the shorter text, or shorter and at an end of the other.
        shorter = np.flatnonzero((whole < cutoff - 1e-9) & (part >= cutoff - 1e-9))
        part[shorter] = self._part(queries, who[some[shorter]], name[some[shorter]], own[shorter])
        fits = np.maximum(whole, part) >= cutoff - 1e-9
        # In another order of words, texts count 95 of 100.
        several = np.flatnonzero(~fits & (np.array([" " in q for q in queries])[who[some]] | self.several[name[some]]))
        again = self._common([by_words(q) for q in queries], who[some[several]], self.codes_by_words[name[some[several]]])
        fits[several] = 0.95 * np.maximum(*reach(again, n[some[several]], m[some[several]])) >= cutoff - 1e-9
        keep[some] = fits
        return keep

    def _part(self, queries: list[str], who: np.ndarray, name: np.ndarray, common: np.ndarray) -> np.ndarray:
        """The most that partial measures give: by letters in common with all of the longer text, for parts as long as the
        shorter one, and with its beginning or end for shorter parts."""
        n, m = np.array([len(q) for q in queries])[who], self.size[name]
        short = np.minimum(n, m)
        ends = np.maximum(*(self._common(x, who, codes[name], short - 1) for x, codes in ((queries, self.codes), ([q[::-1] for q in queries], self.codes_back))))
        return np.where(np.maximum(n, m) > 8 * short, 0.6, 0.9) * np.maximum(100.0 * common / short, 200.0 * ends / (short + ends))

    def _common(self, texts: list[str], who: np.ndarray, codes: np.ndarray, end: np.ndarray | None = None) -> np.ndarray:
        """Length of the longest common subsequence of each pair, in bit rows of all pairs at once; with ``end``, of the
        shorter text and so many first letters of the longer one."""
        at = np.zeros((len(texts), self.counts.shape[1]), np.uint64)
        for k, t in enumerate(texts):
            if len(t) <= BITS:
                for i, c in enumerate(t):
                    if c in self.letters:
                        at[k, self.letters[c]] |= np.uint64(1 << i)
        n, m = np.array([len(t) for t in texts])[who], (codes > 0).sum(axis=1)
        # Beyond a name's own letters nothing changes; of a longer text only the first bits count.
        stop = m if end is None else np.where(m >= n, end, m)
        if end is not None:
            n = np.where(m >= n, n, end)
        row = np.full(len(who), np.iinfo(np.uint64).max, np.uint64)
        for j in range(codes.shape[1]):
            u = row & np.where(j < stop, at[who, codes[:, j]], np.uint64(0))
            row = (row + u) | (row - u)
        full = np.where(n >= BITS, np.iinfo(np.uint64).max, (np.uint64(1) << np.minimum(n, BITS - 1).astype(np.uint64)) - np.uint64(1))
        return n - np.bitwise_count(row & full).astype(np.int64)
