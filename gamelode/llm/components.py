"""Connected components of a link table: local union-find, then hooking and pointer jumping.

Every node hooks to the smallest smaller neighbour it has, which makes a forest; pointer jumping flattens it in a number of
rounds logarithmic in its depth; links are then renamed to the roots, and what still joins different roots goes round
again. Each round is one aggregation or join over the links; the driver sees counts alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _local_union_find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each batch shrink to (node, smallest node of its group in this batch)."""
    for batch in parts:
        parent: dict[int, int] = {}

        def find(x: int, parent: dict[int, int] = parent) -> int:
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        pairs = [(x, r) for x in parent if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], names=["a", "b"])


def _roots(forest: DataFrame) -> DataFrame:
    """forest: a, b (b < a, one row per a), stored. The same with b the root of a's tree."""
    while True:
        up = forest.select(F.col("a").alias("b"), F.col("b").alias("c"))
        if not forest.join(up, "b", "left_semi").limit(1).count():
            return forest
        forest = stored(forest.join(up, "b", "left").select("a", F.coalesce("c", "b").alias("b")), "forest")


def rename(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """column replaced by its component in names (node, component), where it has one."""
    to = names.select(F.col("node").alias(column), F.col("component").alias("_to"))
    return rows.join(to, column, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def compose(names: DataFrame | None, more: DataFrame) -> DataFrame:
    """names followed by more: both node, component; more renames components of names (and nodes that names lacks)."""
    return more if names is None else rename(names, "component", more).select("node", "component").unionByName(more)


def connected_components(links: DataFrame) -> DataFrame:
    """links: a, b (bigint). One row per node that is not the smallest of its component: node, component."""
    ordered = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") != F.col("b"))
    ordered = stored(ordered, "links")  # so that a task runs one Python worker at a time
    left = stored(ordered.mapInArrow(_local_union_find, "a bigint, b bigint"), "links")
    names = None
    while True:
        hooked = _roots(stored(left.groupBy("a").agg(F.min("b").alias("b")), "forest"))
        step = hooked.select(F.col("a").alias("node"), F.col("b").alias("component"))
        names = stored(compose(names, step), "names")
        moved = rename(rename(left, "a", step), "b", step).filter("a != b")
        left = stored(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
        if not left.limit(1).count():
            return names
