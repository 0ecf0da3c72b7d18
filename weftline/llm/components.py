"""Connected components of an edge table: union-find inside each partition, then rounds between them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import Scratch, split_join


class UnionFind:
    """Sets of numbers; the root of a set is its least member."""

    def __init__(self):
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent[x]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a partition as a forest of stars: one row for each node that isn't the least of its set."""
    sets = UnionFind()
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(u, v)
    rows = [(x, r) for x in sets.parent if (r := sets.find(x)) != x]
    for a in range(0, len(rows), 1 << 16):
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[a: a + (1 << 16)]], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _gathered(edges: DataFrame) -> DataFrame:
    """The neighbours of each node that is a larger end, joined to sets in one partition. Forests of the partitions go there, so a hub has a row from each, not all its edges."""
    forests = edges.mapInArrow(_contract, "u long, v long")
    return forests.repartition("u").mapInArrow(_contract, "u long, v long")


def _linked_to_least(edges: DataFrame) -> DataFrame:
    """Links the larger neighbours of each node to the least of its neighbours. A hub's edges are split where they meet its least neighbour."""
    both = edges.union(edges.select("v", "u")).toDF("n", "x")
    least = both.groupBy("n").agg(F.min("x").alias("m")).select("n", F.least("m", "n").alias("m"))
    return split_join(both, least, ["n"]).where("x > n").select(F.col("x").alias("u"), F.col("m").alias("v"))


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component): the nodes of ``edges`` (two long columns) with the least node they reach.

    Loops and repeated edges do no harm, null ends are ignored, and no edges give no rows. Only two
    numbers a round come to the driver, the edges' count and a checksum; a round's table goes when the next is written.
    """
    u, v = edges.columns
    pairs = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v))).select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v"))
    now, seen = scratch.keep(_gathered(pairs)), None
    while (state := now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()) != seen and state[0]:
        seen, before = state, now
        now = scratch.keep(_gathered(_linked_to_least(before)))
        scratch.drop(before)
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
