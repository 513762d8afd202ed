"""Counters of texts that repeat one trigram very often."""

import pyarrow as pa

from surveymend.llm import fingerprints


def test_counters_of_many_repeats_keep_their_sign():
    own = fingerprints.vectors(pa.array(["word " * 100_000, "word " * 20_000, "word " * 40_000], pa.large_string()))
    rows = [tuple(v[k : k + 1] for v in own) for k in range(3)]
    assert fingerprints.likeness(rows[0], rows[1])[0] > 0.99 and fingerprints.likeness(rows[2], rows[1])[0] > 0.99
    text = fingerprints.text_of(*own)
    assert fingerprints.combined(fingerprints.combined(text[0], text[1]), text[1], -1) == text[0]
