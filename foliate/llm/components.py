"""Connected components of an edge table by alternating stars: every node of a component ends up linked to its smallest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.llm import common

#: Edges that a task contracts by itself, 16 bytes each.
FEW = 500_000


def _in_place_of(old: DataFrame, new: DataFrame, name: str) -> DataFrame:
    """new staged, old deleted."""
    new = common.staged(new, name)
    common.discard(old)
    return new


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges, and of each the smallest node of its component."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        high, low = np.maximum(root[a], root[b]), np.minimum(root[a], root[b])
        apart = high > low
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])  # roots go under smaller ones, so there is no circle
        while (root != (above := root[root])).any():
            root = above
    return nodes, nodes[root]


def contracted(edges: DataFrame, parts: int) -> DataFrame:
    """edges: u, v of whole numbers, staged. Of each of the parts, its nodes with their smallest node in the part: node, root."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = [(x.column("u").to_numpy(), x.column("v").to_numpy()) for x in batches if x.num_rows]
        if both:
            found = stars(*(np.concatenate(x) for x in zip(*both, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "root"])

    return edges.select("u", "v").coalesce(parts).mapInArrow(run, "node bigint, root bigint")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v of one type, any direction, repeats and loops allowed. Returns node, root: a row for each node of an edge that isn't a loop, with its component's smallest node; staged if nodes are whole numbers.

    Edges between whole numbers are contracted first, about FEW in a task; up to FEW are done with that. Then each round is written to the
    shared folder, so lineage stays short, and what the round before wrote is deleted. A hub meets its neighbours in an aggregation
    with partial sums and in a join that Spark may split; no node's neighbours are gathered.
    """
    e = common.staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if whole_numbers := e.schema["u"].dataType.simpleString() == "bigint":
        common.prepare(e.sparkSession)
        parts = max(1, -(-e.count() // FEW))
        nodes = contracted(e, parts)
        if parts == 1:
            return _in_place_of(e, nodes, "roots")
        e = _in_place_of(e, nodes.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct(), "edges")
    before = _state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the smallest neighbours are written first, so that both sides of a join are dealt anew and a hub can be split
        least = common.staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.staged(large, "stars")
        common.discard(least)
        least = common.staged(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        e = _in_place_of(e, small.where("u <> v").distinct(), "edges")
        common.discard(large, least)
        if (now := _state(e)) == before:
            break
        before = now
    found = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    return _in_place_of(e, found, "roots") if whole_numbers else found
