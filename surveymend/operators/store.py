"""Stored indexes: vectors as a versioned Parquet layout with a manifest, and a registry by street and house as a bucketed table."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..session import cut, delete
from . import vectors
from .relational import few

#: Rows of a stored file, at most.
FILE_ROWS = 500_000
_MANIFEST = "generation long, entry string, rows long, dim int, kind string, made timestamp"


class VectorStore:
    """Vectors (vec_id, v) on disk under a folder that all executors share: exact values, added without rewriting.

    ``parts/<entry>`` holds the vectors of one build or append, ordered by vec_id, and ``manifest`` a row for each entry,
    which is written last. So an entry that broke off isn't in the manifest and is never read, and readers see whole
    entries only. A build begins a new generation; older ones stay until ``vacuum``. All vectors of a generation have one
    length and element type; null vectors are left out. Ids may repeat, as in any flat index.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def manifest(self) -> DataFrame:
        """Entries of all generations; none where nothing has been built."""
        try:
            return self.spark.read.schema(_MANIFEST).parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], _MANIFEST)

    def generation(self) -> int:
        return self.manifest().agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def build(self, rows: DataFrame) -> None:
        """Store the vectors as a new generation."""
        self._write(rows, self.generation() + 1, None)

    def append(self, rows: DataFrame) -> None:
        """Add vectors to the newest generation, or begin one."""
        held = self._entries()
        self._write(rows, held[0]["generation"] if held else 1, held[0] if held else None)

    def _entries(self) -> list:
        """The newest generation's entries: a row for each build or append."""
        all_ = self.manifest()
        newest = all_.agg(F.max("generation").alias("newest"))
        return all_.join(F.broadcast(newest), F.col("generation") == F.col("newest")).drop("newest").orderBy("made", "entry").collect()

    def _write(self, rows: DataFrame, generation: int, like) -> None:
        kind = rows.schema["v"].dataType.elementType.simpleString()
        if like is not None and like["kind"] != kind:
            raise ValueError(f"vectors of {kind} can't be added to those of {like['kind']}")
        entry = uuid.uuid4().hex
        have = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v").filter("v is not null")
        have.repartitionByRange("vec_id").sortWithinPartitions("vec_id").write.option("maxRecordsPerFile", FILE_ROWS).parquet(f"{self.path}/parts/{entry}")
        stored = self.spark.read.parquet(f"{self.path}/parts/{entry}")
        n, least, most = stored.agg(F.count(F.lit(1)), F.min(F.size("v")), F.max(F.size("v"))).first()
        if n and (least != most or like is not None and like["dim"] not in (None, most)):
            raise ValueError(f"vectors of {least} to {most} components, where {like['dim'] if like else 'one length'} was expected")
        row = self.spark.createDataFrame([(generation, entry, n, most, kind)], "generation long, entry string, rows long, dim int, kind string")
        row.withColumn("made", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def read(self) -> DataFrame:
        """(vec_id, v) of the newest generation; filters on vec_id prune files and row groups."""
        held = self._entries()
        if not held:
            raise ValueError(f"nothing has been built under {self.path}")
        return self.spark.read.parquet(*[f"{self.path}/parts/{r['entry']}" for r in held])

    def reconstruct(self, ids: DataFrame) -> DataFrame:
        """(vec_id, v), exactly as stored, of a table of vec_ids; unknown ids give no row."""
        return self.read().join(few(ids.select(F.col("vec_id").cast("long").alias("vec_id")).distinct()), "vec_id", "left_semi")

    def search(self, queries: DataFrame, k: int = 1) -> DataFrame:
        """The exact k nearest stored rows of (query_id, v), by inner product."""
        return vectors.nearest_rows(queries, self.read(), k)

    def vacuum(self) -> int:
        """Delete the parts of older generations, and of writes that broke off; how many. No writer may be at work."""
        keep = {r["entry"] for r in self._entries()}
        parts = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/parts")
        fs = parts.getFileSystem(self.spark._jsc.hadoopConfiguration())
        have = [s.getPath().getName() for s in fs.listStatus(parts)] if fs.exists(parts) else []
        return sum(delete(self.spark, f"{self.path}/parts/{name}") for name in have if name not in keep)


class HouseIndex:
    """Registry rows by folded street and house number as a bucketed and sorted table, so lookups don't shuffle the registry.

    The table is a new one for each build, named by it, and outlives the session as tables of its catalog do.
    """

    def __init__(self, spark: SparkSession, table: str):
        self.spark, self.table = spark, table

    @classmethod
    def build(cls, registry: DataFrame, table: str, buckets: int = 64) -> HouseIndex:
        """Store a registry with vejnavn and husnr. Streets are folded and house numbers in lower case; rows without either
        stay, under an empty street or number. A bucket's rows lie in one file, sorted."""
        keyed = registry.withColumns({"street_norm": F.coalesce(tx.fold(F.col("vejnavn")), F.lit("")), "house": F.lower(F.coalesce(F.col("husnr").cast("string"), F.lit("")))})
        keyed.repartition(buckets, "street_norm", "house").write.mode("overwrite").bucketBy(buckets, "street_norm", "house").sortBy("street_norm", "house").saveAsTable(table)
        return cls(registry.sparkSession, table)

    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def lookup(self, asked: DataFrame, street: str = "street", house: str = "house") -> DataFrame:
        """Every asked row with each registry row of its street and house. Equal keys are asked once, so however often a key
        is asked, its task has the key's registry rows once; the questions come back by a join that Spark can split."""
        keys = cut(asked.select(F.coalesce(tx.fold(F.col(street)), F.lit("")).alias("street_norm"), F.lower(F.coalesce(F.col(house).cast("string"), F.lit(""))).alias("house")).distinct())
        found = self.rows().join(keys.hint("merge"), ["street_norm", "house"])
        taken = {c.lower() for c in asked.columns}
        found = found.select(*[F.col(c).alias(f"r_{c}" if c.lower() in taken else c) for c in found.columns if c not in ("street_norm", "house")], F.col("street_norm").alias("__s"), F.col("house").alias("__h"))
        mine = asked.withColumns({"__street": F.coalesce(tx.fold(F.col(street)), F.lit("")), "__house": F.lower(F.coalesce(F.col(house).cast("string"), F.lit("")))})
        return mine.join(found, (F.col("__street") == F.col("__s")) & (F.col("__house") == F.col("__h"))).drop("__street", "__house", "__s", "__h")

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")
