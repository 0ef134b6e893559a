"""Connected components by repeated contraction, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.session import fits
from codeloom.sources.tables import saved

FEW_EDGES = 1 << 20


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the undirected ``edges`` (a, b); root is the smallest node reached.

    While there are more than ``FEW_EDGES`` edges, rounds contract them: in a round every node moves to the neighbour, or itself, of least random
    rank, and edges are drawn between the places moved to; chains shrink by a
    constant factor, stars vanish at once. Sums are taken before rows are
    shuffled, so a node with very many edges is no hot spot. The edges that are left, at
    most ``FEW_EDGES`` of them, are solved in one task, whose memory that number bounds; this spares the
    many small jobs of the last rounds.
    """
    edges = saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    labels, turn = None, 0
    while not fits(edges, FEW_EDGES):
        rank = lambda c: F.xxhash64(F.lit(turn), c)  # noqa: E731, B023
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min_by("b", rank(F.col("b"))).alias("b"))
        moved = saved(near.select(F.col("a").alias("node"), F.when(rank(F.col("b")) < rank(F.col("a")), F.col("b")).otherwise(F.col("a")).alias("root")), "moves")
        if labels is None:
            labels = moved
        else:
            step = moved.select(F.col("node").alias("root"), F.col("root").alias("_to"))
            labels = saved(labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
        left = moved.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        right = moved.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        edges = saved(edges.join(left, "a").join(right, "b").filter("_a <> _b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct(), "edges")
        turn += 1
    kind = edges.schema["a"].dataType
    rest = edges.coalesce(1).mapInArrow(_solved, T.StructType([T.StructField("node", kind), T.StructField("root", kind)]))
    if labels is None:
        return saved(rest, "components")
    step = saved(rest, "rest").select(F.col("node").alias("root"), F.col("root").alias("_to"))
    labels = saved(labels.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("root")), "labels")
    least = labels.groupBy("root").agg(F.min("node").alias("_least"))
    return saved(labels.join(least, "root").select("node", F.col("_least").alias("root")), "components")


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of the edges of one task."""
    given = [(b.column("a").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False)) for b in batches]
    if not given:
        return
    a, b = (np.concatenate(side) for side in zip(*given))
    names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = smallest_places(len(names), place[: len(a)], place[len(a) :])
    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[root])], names=["node", "root"])


def smallest_places(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest place reached from each of ``n`` places along pairs."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
