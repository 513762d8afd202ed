"""What the pipeline's stages do with nulls, repeated ids, clashing columns and empty tables: every row is accounted for."""

from collections import Counter

import pytest

from surveymend.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, secret_base string, ids long, __key string"
#: Names that stages might use for columns of their own.
CLASHES = "__other __repeated __words __base __spans __key n count id rep component_id n_shingles hot copies size bucket key lang_pred score decoded secret_spans".split()
SENTENCE = "the house of the river was near to the water and the people of it"
OTHER = "das haus am fluss war nahe an dem wasser und die leute aus der stadt"


@pytest.fixture(scope="module")
def stages():
    import corpus_pipeline

    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"{SENTENCE} number {i} {i * 7} {i * 13} {i * 29} more", "en", "a") for i in range(60)] + [(100 + i, f"{OTHER} nummer {i} {i * 7} {i * 13} {i * 29} mehr", "de", None) for i in range(60)]
    rows += [(None, SENTENCE + " without an id", "en", "b"), (None, SENTENCE + " without an id", "en", "b"), (None, None, None, None), (300, None, "en", "a"), (301, "", None, "a"), (302, " 12 !", None, "b")]
    rows += [(400, SENTENCE, "en", "b"), (400, SENTENCE, "en", "b"), (401, SENTENCE, None, "b"), (402, OTHER + " token=abcdefgh12345", "de", "b"), (402, SENTENCE + " and something else altogether here", "en", "b")]
    return spark.createDataFrame([(*r, len(r[1] or ""), "kept", k, "also") for k, r in enumerate(rows)], SCHEMA).cache()


def counted(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def test_language_drops_texts_without_letters_only(spark, docs, stages):
    out = stages["language"](spark, docs, "")
    assert out.columns == docs.columns
    assert counted(docs) - counted(out) == Counter({(None, None): 1, (300, None): 1, (301, ""): 1, (302, " 12 !"): 1})
    assert not counted(out) - counted(docs)
    unlabelled = docs.filter("lang is null")
    assert counted(stages["language"](spark, unlabelled, "")) == counted(unlabelled)


def test_near_duplicates_keep_one_row_of_a_group(spark, docs, stages):
    out = stages["near duplicates"](spark, docs, "")
    assert out.columns == docs.columns
    gone = counted(docs) - counted(out)
    assert gone == Counter({(401, SENTENCE): 1, (400, SENTENCE): 1}) and not counted(out) - counted(docs)


def test_secrets_change_texts_only(spark, docs, stages):
    out = stages["secrets"](spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    before, after = ({r["ids"]: r for r in d.collect()} for d in (docs, out))
    for k, r in after.items():
        hit = "token=" in (before[k]["text"] or "")
        assert r["text"] == (before[k]["text"].replace("token=abcdefgh12345", "[SECRET]") if hit else before[k]["text"])
        assert r["n_chars"] == len(r["text"] or "") and (r["secret_base"], r["__key"]) == ("kept", "also")


def test_mix_takes_rows_as_its_digest_says(spark, docs, stages):
    out = stages["mix"](spark, docs, "")
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r["source"]] += len(r["text"].split())
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r["source"]] += r["size"] * r["copies"]
    assert words == taken and any(r["doc_id"] is None for r in out.collect())


def test_tokens_give_every_row(spark, docs, stages):
    out = stages["tokens"](spark, docs, "").collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in docs.collect())
    assert all(r["n_tokens"] == len(r["ids"]) >= 2 for r in out)


def test_empty_tables_stay_empty(spark, docs, stages):
    for name, stage in stages.items():
        out = stage(spark, docs.limit(0), "")
        assert out.collect() == [] and (name == "tokens" or out.columns == docs.columns)


def test_any_names_pass_every_stage(spark, docs, stages):
    clashing = docs.select("doc_id", "text", "lang", "source", "n_chars", *[docs["n_chars"].alias(c) for c in CLASHES])
    for name, stage in stages.items():
        out, plain = stage(spark, clashing, ""), stage(spark, docs, "")
        if name == "tokens":
            assert Counter((r["doc_id"], r["decoded_sha256"]) for r in out.collect()) == Counter((r["doc_id"], r["decoded_sha256"]) for r in plain.collect())
        else:
            assert out.columns == clashing.columns and counted(out) == counted(plain)


def test_one_id_with_several_texts_gives_the_same_rows_again(spark, docs, stages):
    more = docs.unionByName(docs.filter("doc_id = 402").withColumn("text", docs["source"]))
    first = counted(stages["near duplicates"](spark, more.repartition(5), ""))
    assert all(counted(stages["near duplicates"](spark, more.repartition(n), "")) == first for n in (2, 7))
