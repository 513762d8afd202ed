"""A training corpus in five stages over ``documents``; every stage works on all that the one before it kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents, whatever their names. Rows without an id pass every stage as
others do; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from surveymend.llm import langid, mixing, ngram_join, secrets, sentencepieces
from surveymend.llm.common import cut, fresh

#: Ids of dropped documents that are broadcast at most: 4 MB.
BROADCAST_IDS = 500_000
#: Mixed random decisions and learned models can't be stated in SQL.
ORACLE_SQL = None


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; rejected ones go, as do null texts and those without letters. Without labels none goes."""
    return langid.keep(docs, langid.fit(docs))


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one of least id.

    Rows of null id, and texts without words, stay. Of repeated rows of one id and the same words one stays.
    """
    other, again, said = (fresh(docs, name) for name in ("other", "repeated", "words"))
    others = cut(ngram_join.join(docs).filter("component_id <> doc_id").select(F.col("doc_id").alias(other)).distinct())
    out = docs.join(_few(others), F.col("doc_id").cast("long") == F.col(other), "left_anti")
    repeated = cut(docs.filter("doc_id is not null").groupBy(F.col("doc_id").alias(again)).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(again))
    if repeated.isEmpty():
        return out
    repeated, same = _few(repeated), F.col("doc_id") == F.col(again)
    words = F.translate(F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = out.join(repeated, same, "left_semi").withColumn(said, words)
    wordless = F.coalesce(F.col(said) == "", F.lit(True))
    once = rows.filter(~wordless).dropDuplicates(["doc_id", said]).unionByName(rows.filter(wordless)).drop(said)
    return out.join(repeated, same, "left_anti").unionByName(once)


def _few(ids: DataFrame) -> DataFrame:
    """Few ids are broadcast, so that texts aren't shuffled; more are joined as Spark sees fit."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def scrub(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets replaced by a mark; n_chars follows the text."""
    out = secrets.redact(docs, secrets.train(secrets.training_sample(spark)))
    return out.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids with begin and end, their number, and a digest of the text they decode to."""
    out = sentencepieces.encode(docs.select("doc_id", "text"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language", identify), ("near duplicates", deduplicate), ("secrets", scrub), ("mix", mix), ("tokens", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is cut from its lineage by a table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
