"""Kneser-Ney models against a direct computation, scripts, and rejection."""

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from surveymend.llm import langid

ENGLISH = ["the cat sat on the mat", "a dog and the cat ran", "it was on the table, and then it wasn't", "Then the dog sat", "cats and dogs"]
GERMAN = ["der Hund lag auf dem Sofa", "die Katze und der Hund", "Straße über Äcker", "es war auf dem Tisch", "Hunde und Katzen liegen"]


def signs(text):
    out = []
    for c in text:
        s = c.lower()[0] if c.isalpha() else None
        if s is not None or out and out[-1] is not None:
            out.append(s)
    return out


class Direct:
    """Interpolated Kneser-Ney from the formulas, in dictionaries."""

    def __init__(self, texts, symbols):
        self.symbols, d = symbols, 0.75
        tri = Counter()
        for t in texts:
            s = [None, None, *signs(t)]
            tri.update(zip(s, s[1:], s[2:]))  # noqa: B905
        bi = Counter((v, w) for _, v, w in tri)
        uni = Counter((w,) for _, w in bi)
        self.levels = []
        for counts in (uni, bi, tri):
            total, kinds = defaultdict(float), defaultdict(int)
            for g, n in counts.items():
                total[g[:-1]] += n
                kinds[g[:-1]] += 1
            self.levels.append(({g: (n - d) / total[g[:-1]] for g, n in counts.items()}, {c: d * kinds[c] / total[c] for c in total}))

    def p(self, gram):
        if not gram:
            return 1 / self.symbols
        left, weight = self.levels[len(gram) - 1]
        return left.get(gram, 0.0) + weight.get(gram[:-1], 1.0) * self.p(gram[1:])

    def entropy(self, text):
        s = [None, None, *signs(text)]
        return -sum(math.log(self.p(g)) for g in zip(s, s[1:], s[2:])) / (len(s) - 2)  # noqa: B905


def counted(texts):
    codes = np.concatenate([c for _, _, c, _ in langid.symbols(pa.array(texts))])
    u, n = np.unique(codes, return_counts=True)
    return u, n.astype(float)


def test_entropies_equal_the_formulas():
    model = langid.model_of({"en": counted(ENGLISH), "de": counted(GERMAN)})
    symbols = len({s for t in ENGLISH + GERMAN for s in signs(t)}) + 1
    asked = [*ENGLISH, *GERMAN, "zyx qqq", "Пример", "the Пример über", "a", "😀 the 12 cat", "中文", "x" * 50, "𐐀𐐁 the"]
    got, n, letters = langid.scores(model, pa.array(asked))
    assert model.languages == ["de", "en"]
    for i, t in enumerate(asked):
        assert n[i] == len(signs(t)) and letters[i] == sum(s is not None for s in signs(t))
        for k, texts in enumerate((GERMAN, ENGLISH)):
            assert got[i, k] == pytest.approx(Direct(texts, symbols).entropy(t), rel=1e-5)


def test_probabilities_sum_to_one():
    codes, n = counted(ENGLISH)
    known = np.unique(codes & langid._MASK)
    m = langid.kneser_ney(codes, n, len(known) + 1)
    contexts = np.unique(np.append(codes >> langid.BITS, [ord("q") << langid.BITS | ord("q")]))
    for c in contexts:
        every = np.append(known, 0x4E2D) | (c << langid.BITS)
        assert m.probability(3, every).sum() == pytest.approx(1) and m.probability(2, every).sum() == pytest.approx(1)


def test_hashed_rows_are_found():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 62, 5000))
    table = langid.Hashed(codes, np.arange(len(codes)))
    seen, at = table.find(codes)
    assert seen.all() and (table.rows[at] == np.arange(len(codes))).all()
    assert not table.find(codes + 1)[0][~np.isin(codes + 1, codes)].any()
    assert langid.Hashed(codes[:1], np.arange(1)).find(codes[:3])[0].tolist() == [True, False, False]


def sentence(rng, words, n):
    return " ".join(rng.choice(words, n))


def test_scripts_are_told_apart_and_foreign_texts_rejected(spark):
    rng = np.random.default_rng(2)
    words = {"en": "the of and house water little people would there about".split(), "ru": "дом вода люди который было очень время только ещё свой".split(), "zh": list("中文的是不了在人有我他这大来")}
    rows = [(i, sentence(rng, words[x], 60), x) for i, x in enumerate(["en", "ru", "zh"] * 80)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, sentence(rng, words[x], 60), x) for k, x in enumerate(words)] + [(10, "ελληνικά κείμενα που δεν έχουν ξαναδεί ποτέ εδώ " * 10, None), (11, "xqzjk vwpfq kkjzx qqwxz jvkqx zzzkj wqpxv kjqzx " * 10, None), (12, " 12 😀 ", None), (13, None, None), (14, "", None)]
    docs = spark.createDataFrame(asked, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert [got[k]["lang_pred"] for k in range(3)] == list(words)
    assert {k for k, r in got.items() if r["rejected"]} == {10, 11, 12, 13, 14}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (12, 13, 14))
    assert sorted(r["doc_id"] for r in langid.keep(docs, model).collect()) == [0, 1, 2]
    assert langid.keep(docs.limit(0), model).collect() == []


def test_one_language_and_none(spark):
    docs = spark.createDataFrame([(i, "the cat sat on the mat and saw it", "en") for i in range(40)] + [(50, "der Hund", None)], "doc_id long, text string, lang string")
    assert langid.keep(docs, langid.fit(docs)).count() >= 40
    assert langid.fit(docs.filter("lang is null")) is None
    assert langid.keep(docs, None).count() == 41
