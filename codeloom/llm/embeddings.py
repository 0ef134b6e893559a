"""Near-duplicate vectors by sorted projection passes.

A pass gives every vector a code, the signs of 63 random projections one after the other, sorts
the vectors of a label by it and compares each with its neighbours in that order: the order is cut into blocks, and a
block is compared with itself and the next one in double precision. Passes with new
projections are made in rounds of ``PASSES``, with larger blocks each round up to ``TILE_BYTES``; a label takes part in
rounds until it has had the passes that its size asks for and a whole round met no new link in
it. A label of up to a block's vectors is compared whole in its first pass. Links are joined across passes.

A vector carries its blocks of all passes, so that the task where two vectors meet again knows
that they were compared before: links are counted once, and pairs never leave a task, only
a count for each vector and the links that join groups. Equal vectors of a label are one node, which counts as
often as it occurs; no label, code or vector is too frequent for a task, as blocks are cut by place.

Vectors that are NULL, empty, zero or hold NULL or non-finite components, and those
with a NULL label or vec_id, link with nothing. Vectors of different lengths do
not link. Rows that share a vec_id are one vector (the smallest row by label and
bytes); every row is returned. An empty table gives no row. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.llm.graph import components, smallest_places
from codeloom.sources.tables import saved

PASSES = 3  # of a round
BLOCK = 2048  # vectors of a block in the first round
TOGETHER = 4  # blocks of a task, besides the first of the next task
TILE_BYTES = 1 << 23  # of a block at most
CELLS = 1 << 20  # products held at a time
BITS = 63


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, label, dims and unit vector of the vectors that can link."""
    for batch in batches:
        rows = batch.column(1)
        sizes = pa.compute.fill_null(pa.compute.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        for dims in np.unique(sizes[sizes > 0]).tolist():
            at = np.flatnonzero(sizes == dims)
            flat = pa.compute.list_flatten(rows.take(pa.array(at))).to_numpy(zero_copy_only=False).astype(np.float64)
            x = flat.reshape(len(at), dims)
            with np.errstate(all="ignore"):
                # Scaled first, so that squares of very large or small numbers stay in range.
                top = np.abs(x).max(axis=1)
                x = x / top[:, None]
                x = x / np.sqrt((x * x).sum(axis=1))[:, None]
            good = np.isfinite(x).all(axis=1)
            x, at = x[good], at[good]
            if not len(at):
                continue
            take = pa.array(at)
            yield pa.RecordBatch.from_pydict(
                {
                    "vec_id": batch.column(0).take(take),
                    "label": batch.column(2).take(take),
                    "dims": pa.array(np.full(len(at), dims, np.int32)),
                    "unit": pa.array([row.tobytes() for row in x], pa.binary()),
                }
            )


def codes(x: np.ndarray, turn: int) -> np.ndarray:
    """Signs of the projections of a pass, the first one in the highest bit."""
    planes = np.random.default_rng([2_718, turn, x.shape[1]]).standard_normal((x.shape[1], BITS))
    return ((x @ planes) > 0) @ (np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _passes(first: int):
    """(node, label, dims, turn, code) for each pass of a round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for size in np.unique(dims).tolist():
                some = batch.take(pa.array(np.flatnonzero(dims == size)))
                x = np.frombuffer(b"".join(some.column(3).to_pylist()), np.float64).reshape(some.num_rows, size)
                for turn in range(PASSES):
                    turns = pa.array(np.full(some.num_rows, turn, np.int32))
                    yield pa.RecordBatch.from_arrays([*some.columns[:3], turns, pa.array(codes(x, first + turn))], names=["node", "label", "dims", "turn", "code"])

    return run


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, turn, part, place): the task's number, and the row's place in it."""
    part, start = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        place = pa.array(np.arange(start, start + n, dtype=np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(np.full(n, part, np.int32)), place], names=["node", "turn", "part", "place"])
        start += n


def _places(nodes: DataFrame, first: int) -> DataFrame:
    """(node, turn, at): place of each node in the sorted order of each pass of a round, all passes on one line."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["turn", "label", "dims", "code", "node"]
    coded = nodes.select("node", "label", "dims", "unit").mapInArrow(_passes(first), "node bigint, label string, dims int, turn int, code bigint")
    ranged = coded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    numbered = saved(ranged.mapInArrow(_numbered, "node bigint, turn int, part int, place bigint"), "places")
    # A row for each task of the sort.
    sizes = numbered.groupBy("part").agg(F.count(F.lit(1)).alias("_n"))
    lower = sizes.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_lower"))
    return numbered.join(F.broadcast(lower), "part").select("node", "turn", (F.col("place") + F.col("_lower")).alias("at"))


def _met(x: np.ndarray, copies: np.ndarray, block: np.ndarray, before: np.ndarray, own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes of a label in a pass, sorted by block: new links of each, and the place it is joined to.

    ``before`` are the blocks of earlier passes: two nodes in one block or in neighbouring ones were compared there.
    """
    root, n = np.arange(len(x)), np.zeros(len(x))
    weight = copies.astype(np.float64)  # sums of whole numbers, exact below 2**53
    for b in own:
        low, high, end = np.searchsorted(block, [b, b + 1, b + 2])
        step = max(1, CELLS // max(1, end - low))
        for start in range(low, high, step):
            stop = min(start + step, high)
            i, j = np.nonzero(x[start:stop] @ x[start:end].T >= threshold)
            later = j > i
            i, j = i[later] + start, j[later] + start
            for q in range(before.shape[1]):
                new = np.abs(before[i, q] - before[j, q]) > 1
                i, j = i[new], j[new]
            if len(i):
                n += np.bincount(i, weight[j], len(x)) + np.bincount(j, weight[i], len(x))
                apart = root[i] != root[j]
                root = smallest_places(len(x), root[i[apart]], root[j[apart]])[root]
    return n.astype(np.int64), root


def _compared(first: int, threshold: float):
    """(node, label, dims, n, other) of the nodes of a task with new links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"node": pd.Series(dtype="int64"), "label": pd.Series(dtype="str"), "dims": pd.Series(dtype="int32"), "n": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64")})]
        for (turn, label, dims), same in rows.sort_values(["block", "node"]).groupby(["turn", "label", "dims"], sort=False):
            block, node = same["block"].to_numpy(), same["node"].to_numpy()
            own = np.unique(block[(block // TOGETHER) == same["task"].iloc[0]])
            x = np.frombuffer(b"".join(same["unit"]), np.float64).reshape(len(same), -1)
            before = np.stack(same["blocks"].to_numpy())[:, : first + turn]
            n, root = _met(x, same["copies"].to_numpy(), block, before, own, threshold)
            found = np.flatnonzero(n > 0)
            out.append(pd.DataFrame({"node": node[found], "label": label, "dims": dims, "n": n[found], "other": node[root[found]]}))
        return pd.concat(out)

    return run


def _least_passes(size: Column, block: int, threshold: float) -> Column:
    """Passes after which a pair at the threshold in an evenly spread label is missed once in a thousand."""
    agree = 1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    met = F.pow(F.lit(agree), F.greatest(F.lit(0.0), F.log2(size / block)))
    return F.when(size <= block, 1).otherwise(F.ceil(F.lit(math.log(1000)) / met))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding, label)."""
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    usable = rows.filter("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    coded = saved(usable.mapInArrow(_coded, "vec_id bigint, label string, dims int, unit binary"), "coded")
    if not coded.groupBy("vec_id").count().filter("count > 1").isEmpty():
        order = F.struct("label", "unit")
        coded = saved(coded.groupBy("vec_id").agg(F.min_by(F.struct("label", "dims", "unit"), order).alias("_v")).select("vec_id", "_v.*"), "single")

    equal, kind = ["label", "dims", "unit"], ["label", "dims"]
    nodes = saved(coded.groupBy(*equal).agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies")), "nodes")
    sizes = saved(nodes.groupBy(*kind).agg(F.count(F.lit(1)).alias("_m")), "sizes")
    widest = sizes.agg(F.max("dims")).first()[0] or 1
    active, first, size, links = nodes.withColumn("blocks", F.array().cast("array<bigint>")), 0, BLOCK, None
    while True:
        block = max(1, min(size, TILE_BYTES // (8 * widest)))
        now = _places(active, first).groupBy("node").agg(F.array_sort(F.collect_list(F.struct("turn", F.floor(F.col("at") / block).alias("block")))).alias("_now"))
        active = saved(active.join(now, "node").select("node", "label", "dims", "unit", "copies", F.concat("blocks", "_now.block").alias("blocks")), "turns")
        each = active.select("*", F.posexplode(F.slice("blocks", first + 1, PASSES)).alias("turn", "block"))
        task = F.floor(F.col("block") / TOGETHER)
        dealt = each.withColumn("task", F.explode(F.when(F.col("block") % TOGETHER == 0, F.array(task, task - 1)).otherwise(F.array(task))))
        met = saved(dealt.groupBy("task").applyInPandas(_compared(first, threshold), "node bigint, label string, dims int, n bigint, other bigint"), "met")
        links = met if links is None else links.union(met)
        first, size = first + PASSES, 2 * size
        short = sizes.filter(_least_passes(F.col("_m"), block, threshold) > first).select(*kind)
        # A label of a block's vectors or fewer was compared whole.
        grown = met.select(*kind).distinct().join(sizes.filter(F.col("_m") > block), kind, "left_semi")
        open_ = saved(short.union(grown).distinct(), "open")
        if open_.isEmpty():
            break
        active = active.join(open_, kind, "left_semi")

    joined = components(links.select(F.col("node").alias("a"), F.col("other").alias("b")))
    counted = links.groupBy("node").agg(F.sum("n").alias("_n"))
    found = nodes.join(counted, "node", "left").join(joined, "node", "left").select(*equal, (F.col("copies") - 1 + F.coalesce("_n", F.lit(0))).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    found = coded.join(found, equal).select("vec_id", "n_links", "component_id")
    out = rows.select("vec_id").join(found, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
