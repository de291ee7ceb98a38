"""Distributed connected components on DataFrames (no Python on the data path)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tablemere.llm.common import checkpoint, prepare_workers

#: Edges that a worker contracts at once (about 100 bytes each).
LOT = 1 << 19


def star_edges(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links a-b: each node but the least of its component, with that least node."""
    nodes, both = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y, label = both[: len(a)], both[len(a) :], np.arange(len(nodes))
    while True:
        was = label.copy()
        np.minimum.at(label, x, was[y])
        np.minimum.at(label, y, was[x])
        low = np.minimum(label[x], label[y])
        np.minimum.at(label, was[x], low)  # hook the old roots too
        np.minimum.at(label, was[y], low)
        label = label[label]
        if (label == was).all():
            break
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of long nodes with the same components: star edges of each lot of LOT edges, so at most one a node and lot."""
    prepare_workers(edges.sparkSession)

    def made(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b = star_edges(*[np.concatenate([np.asarray(x.column(k)) for x in held]) for k in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held, rows = [*held, batch], rows + batch.num_rows
            if rows >= LOT:
                yield made(held)
                held, rows = [], 0
        if rows:
            yield made(held)

    return edges.select("a", "b").where("a is not null and b is not null").mapInArrow(run, "a long, b long")


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and its row count and order-free hash: two equal stamps mean that the edges no longer change."""
    seen = Observation()
    out = checkpoint(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("h")))
    return out, (seen.get["n"], seen.get["h"])


def _least(edges: DataFrame) -> DataFrame:
    """(src, m): each node's least neighbour.

    A table of its own, so that the join with the edges reads two plain shuffles:
    then AQE can split a node with very many edges, or broadcast a small table.
    """
    return checkpoint(edges.groupBy("src").agg(F.min("dst").alias("m")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.join(_least(both), "src").where("dst > src").select(F.col("dst").alias("src"), F.least("src", "m").alias("dst"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst"))
    least = _least(down)
    moved = down.join(least, "src")
    return moved.where("dst <> m").select(F.col("dst").alias("src"), F.col("m").alias("dst")).union(
        least.select("src", F.col("m").alias("dst"))
    )


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph by alternating large-star and small-star contraction.

    Returns (node, component) for every node that has an edge to another node;
    component is the least node reachable. Loops, repeated edges and null ends
    have no effect; an empty edge table gives an empty result. Each round is an
    aggregation with map-side combine and a join on node, whose hot keys AQE can
    split; rounds grow with the logarithm of the longest path. Links never reach
    the driver: only a count and a hash do, to see that nothing moves any more.
    """
    now, stamp = _stored(
        edges.select(F.greatest(a, b).alias("src"), F.least(a, b).alias("dst"))
        .where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .distinct()
    )
    while stamp[0]:
        now, after = _stored(_small_star(checkpoint(_large_star(now).distinct())).distinct())
        if after == stamp:
            break
        stamp = after
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(
        now.select(F.col("dst"), F.col("dst")).distinct()
    )
