"""Connected components of an edge table, by large-star and small-star rounds, each checkpointed."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mapped, ready


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition as stars: every node with the smallest that it reaches there."""
    root: dict[int, int] = {}

    def top(x: int) -> int:
        while (r := root.setdefault(x, x)) != x:
            root[x] = x = root[r] if root[r] != r else r
        return x

    for batch in batches:
        for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
            a, b = top(a), top(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    found = [(x, top(x)) for x in list(root)]
    u, v = [x for x, r in found if x != r], [r for x, r in found if x != r]
    for k in range(0, len(u), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array(u[k : k + (1 << 16)], pa.int64()), pa.array(v[k : k + (1 << 16)], pa.int64())], names=["u", "v"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of an edge (a, b). No edges give no rows.

    Both kinds of star link each node to a smaller one, so a long path halves with every round. Sums that tell whether
    anything changed are the only values that reach the driver. Partitions are first reduced to stars on their own, which
    leaves few rounds.
    """
    ready(edges.sparkSession)
    links = cut(mapped(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), _forest, "u long, v long"))
    before = None
    for _ in range(rounds):
        # Large star: each node's larger neighbours link to its smallest neighbour.
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # Small star: each node's smaller neighbours, and itself, link to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        links = cut(small)
        now = tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    pairs = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionByName(pairs.select(F.col("component").alias("node"), "component").distinct())
