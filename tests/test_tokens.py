"""Training examples of real prompts against a direct computation, and matrices of several frames in one pass."""

import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from surveymend.operators import matrices, prompts, repair, tokens
from surveymend.plans import catalog

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
END, PAD = "<|endoftext|>", 50256


@pytest.fixture(scope="module")
def path():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def direct(library, prompt, response, most):
    """(input_ids, labels) of one example, as a training script makes them."""
    ids = lambda t: library.encode(t, add_special_tokens=False).ids
    p, r = ids(prompt.rstrip() + "\n"), ids(response.rstrip() + END)
    if len(p) + len(r) > most:
        p = p[: max(0, most - len(r))]
    return p + r, [-100] * len(p) + r


@needs_data
@pytest.mark.parametrize("most", [512, 120, 10])
def test_examples_of_real_prompts(spark, path, library, most):
    said = prompts.training_entry(repair.fast_validation(catalog.Views(spark, SF).geo)).limit(300).cache()
    prompt = prompts.formatted(F.col("instruction"), F.col("input"), F.lit(""), "")
    rows = tokens.examples(said.withColumn("p", prompt), F.col("p"), F.col("output"), path, most, END).collect()
    assert len(rows) == 300
    for r in rows:
        ids, labels = direct(library, r["p"], r["output"], most)
        assert r["input_ids"] == ids and r["labels"] == labels and r["attention_mask"] == [1] * len(ids)
    said.unpersist()


ODD = [("a \n\t\x1f ", " b "), ("", ""), (None, "x"), ("x", None), (f"say {END} twice", f"{END}"), ("é漢😀 " * 50, "ok")]


def test_odd_examples(spark, path, library):
    df = spark.createDataFrame([(k, *t) for k, t in enumerate(ODD)], "k int, p string, r string").repartition(2)
    got = {r["k"]: r for r in tokens.examples(df, F.col("p"), F.col("r"), path, 40, END).collect()}
    for k, (p, r) in enumerate(ODD):
        want = (None, None) if p is None or r is None else direct(library, p, r, 40)
        assert (got[k]["input_ids"], got[k]["labels"]) == want
    assert tokens.examples(df.limit(0), F.col("p"), F.col("r"), path, 40, END).collect() == []


def test_special_tokens_may_be_plain_text(spark, path, library):
    df = spark.createDataFrame([(END, None)], "t string, u string")
    r = tokens.encode(df, {"t": "a", "u": "b"}, path, special=False).first()
    assert PAD not in r["a"] and r["b"] is None
    assert tokens.encode(df, {"t": "a"}, path).first()["a"] == [PAD]
    with pytest.raises(ValueError):
        tokens.encode(df, {"t": "u"}, path)


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_padding_of_batches(spark, path, size):
    df = spark.createDataFrame([(k, "word " * (k % 13), f"answer {k}") for k in range(60)] + [(60, None, "x")], "k int, p string, r string").repartition(3)
    one = tokens.examples(df, F.col("p"), F.col("r"), path, 9, END)
    plain = {r["k"]: r for r in one.collect()}
    groups: dict = {}
    for r in tokens.collated(one, size, PAD).collect():
        groups.setdefault(r["batch"], []).append(r)
    assert sum(map(len, groups.values())) == 60 and max(map(len, groups.values())) <= size
    for rows in groups.values():
        longest = max(len(plain[r["k"]]["input_ids"]) for r in rows)
        width = -(-longest // 8) * 8
        for r in rows:
            ids, labels = plain[r["k"]]["input_ids"], plain[r["k"]]["labels"]
            more = width - len(ids)
            assert r["input_ids"] == ids + [PAD] * more and r["attention_mask"] == [1] * len(ids) + [0] * more and r["labels"] == labels + [-100] * more
    if size == 7:
        assert sum(len(rows) < 7 for rows in groups.values()) <= 3  # the last one of each task


def test_instruction_format(spark):
    df = spark.createDataFrame([("i", "in", "out"), (None, "in", "out")], "a string, b string, c string")
    got = [r[0] for r in df.select(prompts.formatted(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [f"{prompts.FRAME}\n\n### Instruction:\ni\n\n### Input:\nin\n\n### Response:\nout</s>", None]


# ---- matrices


@needs_data
def test_all_matrices_read_each_frame_once(spark):
    v = catalog.Views(spark, SF)
    rag = v.rag.join(v.det.select("turid", "stagelength_raw", "stagedurationmin_raw"), "turid")
    specs = [matrices.by_mode(), matrices.by_distance(), matrices.by_time()]
    frames = {"DET": matrices.safe(v.det, "DET"), "RAG": matrices.safe(rag, "RAG")}
    out = matrices.counted(frames, specs)
    plan = matrices.counted({"DET": frames["DET"]}, specs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 and plan.count("Generate inline") == 1 and plan.count("Exchange hashpartitioning(frame") <= 2
    single = [r for name, df in frames.items() for m in specs for r in matrices.counted({name: df}, [m]).collect()]
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, single)) and single


def test_a_pipeline_as_a_table(spark):
    rows = [(1, 10.0, 10.0, "x(85);y(90)"), (1, 12.0, 10.0, "x(80)"), (2, 30.0, 10.0, "x(99)"), (11, 10.6, 10.0, "x(90)"), (12, 5.0, 10.0, "x(90)"), (3, 10.0, 10.0, "x(90)"), (1, 10.0, 10.0, "x(70);y(80)"), (1, 10.0, 0.0, "x(90)"), (1, 10.0, 10.0, None)]
    df = spark.createDataFrame([("corrected", *r) for r in rows], "validation_status string, transportmiddel int, stagelength_raw double, corrected_dist_km double, note string")
    got = {r["row"]: r.asDict() for r in matrices.process_pipeline(df, "DET").collect()}
    assert set(got) == {"Walk", "Car/Van"}
    assert got["Walk"]["Accurate (+/-5%)"] == 50.0 and got["Walk"]["Slight Over"] == 50.0 and got["Walk"]["Extreme (+50%+)"] == 0.0
    assert got["Car/Van"]["Slight Over"] == 50.0 and got["Car/Van"]["Under (-20%+)"] == 50.0


def test_lines_are_encoded_once_and_give_the_ids_of_whole_texts(library):
    said = [f"Trip {k % 5}\nFrom: a{k % 3}\nTo: b{k % 4} \n\n### End:\n" for k in range(400)]
    rng = np.random.default_rng(2)
    pieces = ["\n", "\n", " ", "\t", "\r", "\x1f", " ", " ", "a", "it's", "'s", "9", "#", "é", "漢", END, END[:5], "."]
    odd = ["".join(rng.choice(pieces, rng.integers(0, 14))) for _ in range(3000)]
    for special in (True, False):
        library.encode_special_tokens = not special
        lines = tokens.Lines(library)
        for texts in (said, odd, [None, "", "a\nb", None]):
            assert lines.ids(texts).to_pylist() == [None if t is None else library.encode(t, add_special_tokens=False).ids for t in texts]
            if texts is said:
                assert lines.encoded <= 12
    library.encode_special_tokens = False


def test_lines_stay_whole_where_a_vocabulary_looks_across_them(path):
    from tokenizers import Tokenizer, normalizers

    other = Tokenizer.from_file(path)
    assert tokens.by_lines(other)
    other.normalizer = normalizers.Replace("\na", "a")
    assert not tokens.by_lines(other) and tokens.Lines(other).ids(["x\nab"]).to_pylist() == [other.encode("xab").ids]


def test_examples_of_whole_batches(library):
    rng = np.random.default_rng(3)
    pieces = ["\n", "\n", " ", "\t", "\r", "\x1f", "\x85", " ", "a", "it's", "'s", "9", "#", "é", "漢", END, END[:5], "."]
    odd = ["".join(rng.choice(pieces, rng.integers(0, 14))) if rng.random() < 0.95 else None for _ in range(3000)]
    p, r = odd, odd[1:] + odd[:1]
    lines = tokens.Lines(library)
    library.encode_special_tokens = False
    for kind in (pa.string(), pa.large_string()):
        for lo, n in ((0, 3000), (7, 100), (3, 0)):
            ids, kept = lines.examples(pa.array(p, kind).slice(lo, n), pa.array(r, kind).slice(lo, n), 9, END)
            for a, b, x, k in zip(p[lo : lo + n], r[lo : lo + n], ids.to_pylist(), kept.to_pylist(), strict=True):
                want, labels = (None, []) if a is None or b is None else direct(library, a, b, 9)
                assert x == want and k == labels.count(-100)
    known = lines.encoded
    lines.examples(pa.array(p), pa.array(r), 40, END)
    assert lines.encoded == known


def test_batches_are_cut_by_bytes_and_memory_is_bounded(library, monkeypatch):
    monkeypatch.setattr(tokens, "SOME", 100)
    monkeypatch.setattr(tokens, "LINES", 20)
    texts = [f"line {k}\nof {k}" * (1 + 30 * (k % 7 == 3)) for k in range(60)] + [None]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], names=["t"])
    some = list(tokens._some([batch], ["t"]))
    assert pa.Table.from_batches(some) == pa.Table.from_batches([batch]) and all(b.num_rows == 1 or sum(len(t or "") for t in b["t"].to_pylist()) <= 100 for b in some)
    lines = tokens.Lines(library)
    assert [x for b in some for x in lines.ids(b["t"]).to_pylist()] == [None if t is None else library.encode(t, add_special_tokens=False).ids for t in texts]
    assert sum(map(len, lines.known.values())) < 60 < lines.encoded


@needs_data
def test_only_keys_and_ids_come_back_from_python(spark):
    plan = catalog.QUERIES["tokenized_examples"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "MapInArrow" in x]
    assert [x.split("#")[0] for x in line.rsplit("[", 1)[1].split("]")[0].split(", ")] == ["turid", "delturnr", "input_ids", "__kept"]
    assert "array_repeat(-100" in plan
