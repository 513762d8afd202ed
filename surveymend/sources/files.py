"""CSV, JSON lines and Parquet in and out: declared schemas, older encodings, chunked writes and resumable batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx
from ..session import cut, delete, shared_folder


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, encoding: str = "UTF-8") -> DataFrame:
    """Headered CSV with quoted line ends, in a declared schema; rows that don't parse have nulls."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding=encoding)


def read_text_csv(spark: SparkSession, path: str, columns: list[str], encoding: str = "UTF-8") -> DataFrame:
    """All columns as strings, with blanks kept as empty strings."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"', encoding=encoding, nullValue="\u0000", emptyValue="").na.fill("")


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", by: list[str] | None = None) -> None:
    """One folder of headered CSV, or one for each value of ``by``."""
    w = df.write.mode("overwrite").options(header=True, escape='"', encoding=encoding)
    (w.partitionBy(*by) if by else w).csv(path)


def with_line(registry: DataFrame) -> DataFrame:
    """Add the folded street name and the address in one line, as chunks have them."""
    line = tx.address_line(F.col("vejnavn"), F.col("husnr"), F.col("postnr").cast("string"), F.col("postnrnavn"))
    return registry.withColumns({"vejnavn_norm": tx.fold(F.col("vejnavn")), "line": line})


def write_chunks(registry: DataFrame, path: str, code: str = "kommunekode", encoding: str = "UTF-8") -> None:
    """A folder of CSV for each municipality, with the derived columns."""
    write_csv(with_line(registry), path, encoding, [code])


def through_csv(df: DataFrame, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """A table as it is after it has been written as CSV in the shared folder and read again; the files are deleted."""
    spark = df.sparkSession
    path = shared_folder(spark, "csv")
    write_csv(df, path, encoding)
    out = cut(read_csv(spark, path, schema, encoding))
    delete(spark, path)
    return out


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def merged(*parts: DataFrame) -> DataFrame:
    """All rows of chunks with the same columns, by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_batch(df: DataFrame, path: str, batch: str) -> None:
    """One batch of a resumable run; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
