"""Units beyond what the table holds."""

import struct

from surveymend.llm import sentencepieces


def test_a_full_table_loses_no_unit(monkeypatch):
    p = sentencepieces.Pieces(sentencepieces.model_path())
    monkeypatch.setattr(sentencepieces, "KEPT_UNITS", 10)
    words = [f"{a}{b}" for a in ("one", "two", "té", "x\x00", "中") for b in ("", "s", "ly", "<s>")]
    texts = [" ".join(words), " ".join(words[:6]), " ".join(words[3:9] + words[:4]), "one two", " ".join(words * 3), " ".join(reversed(words))]
    for t in texts * 2:
        ids, said = p.ids(t)
        want = p.library.encode(t)
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == want and said == p.library.decode(want)
        assert len(p.word) <= 10


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "one two", [9], "old"), (2, None, None, None)], "doc_id long, text string, ids array<int>, decoded string")
    got = {r["doc_id"]: r for r in sentencepieces.encode(docs).collect()}
    assert got[1]["decoded"] == "one two" and got[2]["decoded"] == "" and len(got[2]["ids"]) == 2
    assert sentencepieces.encode(docs.limit(0)).collect() == []


def test_no_unit_differs_from_the_library(spark, capsys):
    p = sentencepieces.Pieces(sentencepieces.model_path())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        p.ids(r["text"] or "")
    assert p.differing == 0 and len(p.word) > 1000 and "otherwise" not in capsys.readouterr().err
    del p.score["▁the"]  # an agenda that is wrong is noticed
    p.word.clear()
    ids, said = p.ids("to the test")
    assert p.differing and list(struct.unpack(f"<{len(ids) // 4}I", ids)) == p.library.encode("to the test") and said == "to the test"
    assert "otherwise" in capsys.readouterr().err
