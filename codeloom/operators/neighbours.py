"""Exact searches over many vectors: all within a distance, or the nearest, with bounds from pivots.

A vector's distances to a few pivots bound its distance to any other vector: by the
triangle inequality it is at least the difference of the two distances to a pivot. Vectors, and
queries likewise, are dealt to buckets by their nearest pivot and their distance to it, and written in that order
in packs; a pack, and each block of vectors in it, knows the least and greatest distance to every
pivot. A grid of tasks reads its shares of both tables; a pack of queries meets the packs it can reach, and a query is
compared with the blocks there that it can reach. What is skipped cannot hold a result, whichever pivots were drawn.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.ranking import first_n
from codeloom.operators.retrieval import norms, squared
from codeloom.sources.tables import saved

# Fixed value: the declared similarity of unit vectors from which a chunk counts as a hit.
SIMILARITY = 0.7

PIVOTS = 16
SAMPLE_ROWS = 4096  # vectors that the pivots are drawn from: those whose keys have the least hashes
RINGS = 32  # buckets of one pivot, so that the table of buckets has at most PIVOTS x RINGS rows
BLOCK_ROWS = 256
PACK_ROWS = 4096
LANE_ROWS = 65_536  # a bucket with more vectors is dealt to several lanes
MOST_PARTS = 512  # tasks that pack
SHARE_BYTES = 1 << 26  # of vectors that a task of the grid holds
TASKS_PER_CORE = 4
CELLS = 1 << 22  # numbers held to measure pairs
HELD_ROWS = 500_000
SLACK = 1e-6
ROUNDING = 1e-9  # more than a score's rounding


def max_distance(similarity: float = SIMILARITY) -> float:
    """Squared distance of unit vectors of that cosine."""
    return 2.0 * (1.0 - similarity)


@dataclass
class PivotIndex:
    """Packed vectors in a written table, and the pivots and sizes of the buckets: arrays of bounded size."""

    pivots: np.ndarray
    width: float
    buckets: np.ndarray  # bucket numbers
    sizes: np.ndarray  # vectors in each
    packs: DataFrame  # as ``_packed`` gives them
    key_type: T.DataType


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows, and which of the given ones these are: none that is NULL, empty or not finite."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    ok = sizes > 0
    if not ok.any():
        return np.zeros((0, 1), np.float32), ok
    if len(np.unique(sizes[ok])) > 1:
        raise ValueError("vectors of different lengths")
    with np.errstate(over="ignore"):
        flat = column.filter(pa.array(ok)).flatten().to_numpy(zero_copy_only=False).astype(np.float32)
    rows = flat.reshape(ok.sum(), -1)
    finite = np.isfinite(rows).all(axis=1)
    ok[np.flatnonzero(ok)[~finite]] = False
    return rows[finite], ok


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    out = np.empty((len(rows), len(pivots)))
    for i, pivot in enumerate(pivots):
        out[:, i] = np.sqrt(((rows.astype(np.float64) - pivot) ** 2).sum(axis=1))
    return out


def _bucket(distances: np.ndarray, width: float) -> np.ndarray:
    nearest = distances.argmin(axis=1)
    ring = np.minimum(distances.min(axis=1) / width, RINGS - 1).astype(np.int64)
    return nearest * RINGS + ring


def _draw(vectors: DataFrame, key: str, vector: str, n: int) -> tuple[np.ndarray, float]:
    """Pivots far from each other, and the width of a ring."""
    drawn = vectors.select(key, vector).filter(F.col(vector).isNotNull()).orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS)
    rows, _ = _matrix(drawn.select(vector).toArrow().column(0).combine_chunks())
    if not len(rows):
        return np.zeros((1, 1)), 1.0
    chosen = [0]
    gap = _distances(rows, rows[:1])[:, 0]
    while len(chosen) < n and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen].astype(np.float64), float(gap.max() / (RINGS - 1)) or 1.0


def _blocks(groups: np.ndarray, shares: np.ndarray, block_rows: int, pack_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Where blocks start in rows sorted by group, and where packs do: at a block, and with one share's rows only."""
    n = len(groups)
    first = np.flatnonzero(np.diff(groups, prepend=groups[:1] - 1))
    starts = np.flatnonzero((np.arange(n) - np.repeat(first, np.diff(first, append=n))) % block_rows == 0)
    packs, ends = [], np.append(starts[1:], n)
    for start, end in zip(starts, ends):
        if not packs or end - packs[-1] > pack_rows or shares[start] != shares[packs[-1]]:
            packs.append(start)
    return starts, np.array(packs)


def _packed(rows: DataFrame, points: np.ndarray, width: float, purpose: str) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(key, vector) rows in written packs, and the numbers and sizes of their buckets.

    The rows are read once. A pack has its number, the bucket most of its rows are in, the buckets that begin in it, keys, vectors,
    its least and greatest distances to the pivots, the same of its blocks and where they start, and each row's place
    among the equal vectors before it, by key.
    """
    key_type = rows.schema["key"].dataType

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ok = _matrix(batch.column(1))
            if len(found):
                far = _distances(found, points)
                columns = [pa.array(_bucket(far, width)), pa.array(far.min(axis=1)), batch.column(0).filter(pa.array(ok)), pa.array([r.tobytes() for r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "near", "key", "data"])

    one = T.StructType([T.StructField("bucket", T.LongType()), T.StructField("near", T.DoubleType()), T.StructField("key", key_type), T.StructField("data", T.BinaryType())])
    placed = saved(rows.select("key", "vector").mapInArrow(place, one), f"{purpose}-placed")
    table = placed.groupBy("bucket").count().orderBy("bucket").toPandas()  # at most PIVOTS x RINGS rows
    buckets, sizes = table["bucket"].to_numpy(np.int64), table["count"].to_numpy(np.int64)
    lanes = -(-sizes // LANE_ROWS)
    parts = int(min(MOST_PARTS, max(1, sizes.sum() // PACK_ROWS)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number, begun, held = TaskContext.get().partitionId() << 32, 0, set(), None
        for batch in chain(batches, [None]):
            if batch is not None:
                more = pa.Table.from_batches([batch])
                held = more if held is None else pa.concat_tables([held, more])
                if held.num_rows < 2 * PACK_ROWS:
                    continue
            if held is None:
                return
            bucket, lane, share = (held.column(c).to_numpy() for c in ("bucket", "lane", "share"))
            first = (np.diff(bucket, prepend=-1) != 0) | (np.diff(lane, prepend=-1) != 0) | (np.diff(share, prepend=-1) != 0)
            starts, packs = _blocks(np.cumsum(first), share, BLOCK_ROWS, PACK_ROWS)
            for i, start in enumerate(packs):
                if batch is not None and i + 1 == len(packs):
                    held = held.slice(start)  # more rows may follow
                    break
                end = packs[i + 1] if i + 1 < len(packs) else len(bucket)
                data = b"".join(held.column("data").slice(start, end - start).to_pylist())
                vectors = np.frombuffer(data, np.float32).reshape(end - start, -1)
                far = _distances(vectors, points)
                blocks = starts[(starts >= start) & (starts < end)] - start
                low, high = np.minimum.reduceat(far, blocks), np.maximum.reduceat(far, blocks)
                bits = vectors.view(np.uint32)
                fresh = first[start:end].copy()
                fresh[0], fresh[1:] = True, fresh[1:] | (bits[1:] != bits[:-1]).any(axis=1)
                at = np.flatnonzero(fresh)
                copies = np.arange(len(fresh)) - np.repeat(at, np.diff(at, append=len(fresh)))
                values, counts = np.unique(bucket[start:end], return_counts=True)
                homes = [b for b in np.unique(bucket[start:end][lane[start:end] == 0]).tolist() if b not in begun]
                begun.update(homes)
                yield pa.RecordBatch.from_pydict(
                    {
                        "no": [task + number], "bucket": [int(values[counts.argmax()])], "homes": pa.array([homes], pa.list_(pa.int64())),
                        "keys": pa.ListArray.from_arrays([0, end - start], held.column("key").slice(start, end - start).combine_chunks()),
                        "data": [data], "low": [far.min(axis=0)], "high": [far.max(axis=0)],
                        "starts": pa.array([blocks.astype(np.int64).tobytes()], pa.binary()), "lows": [low.tobytes()], "highs": [high.tobytes()],
                        "copies": [copies.astype(np.int64).tobytes()],
                    }
                )
                number += 1

    long, binary, doubles = T.LongType(), T.BinaryType(), T.ArrayType(T.DoubleType())
    types = {
        "no": long, "bucket": long, "homes": T.ArrayType(long), "keys": T.ArrayType(key_type), "data": binary, "low": doubles, "high": doubles,
        "starts": binary, "lows": binary, "highs": binary, "copies": binary,
    }
    # Where each bucket starts in the order of all rows: shares are stretches of that order, of about a pack.
    line = list(zip(buckets.tolist(), sizes.tolist(), lanes.tolist(), (np.cumsum(sizes) - sizes).tolist()))
    where = rows.sparkSession.createDataFrame(line, "bucket bigint, size bigint, lanes bigint, start bigint")
    dealt = placed.join(F.broadcast(where), "bucket").withColumn("lane", F.pmod(F.xxhash64("key", "data"), "lanes"))
    dealt = dealt.select("bucket", "lane", F.floor((F.col("start") + F.col("lane") * F.col("size") / F.col("lanes")) / PACK_ROWS).alias("share"), "near", "key", "data")
    ordered = dealt.repartition(parts, "share").sortWithinPartitions("share", "bucket", "lane", "near", "data", "key")
    packs = ordered.mapInArrow(pack, T.StructType([T.StructField(n, t) for n, t in types.items()]))
    return saved(packs, f"{purpose}-packs"), buckets, sizes


def build(vectors: DataFrame, key: str = "key", vector: str = "embedding", pivots: int = PIVOTS) -> PivotIndex:
    """Index over (key, vector) rows, which are read twice: to draw the pivots, and to pack them.

    A vector that is NULL, empty or not finite is left out. Vectors are stored as 32-bit floats.
    """
    points, width = _draw(vectors, key, vector, pivots)
    packs, buckets, sizes = _packed(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), points, width, "vector")
    return PivotIndex(points, width, buckets, sizes, packs, vectors.schema[key].dataType)


def _floats(column: pa.Array, i: int, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(column[i].as_buffer(), kind)


def _set(flags: np.ndarray) -> np.ndarray:
    """Numbers of the flags that are set, which are few: eight are looked at together."""
    if len(flags) % 8:
        return np.flatnonzero(flags)
    some = np.flatnonzero(flags.view(np.uint64))
    i, j = np.nonzero(flags.reshape(-1, 8)[some])
    return 8 * some[i] + j


class _Vectors:
    """A pack of vectors, ready for products. Of equal ones only the first ``k`` by key are taken, if given."""

    def __init__(self, batch: pa.RecordBatch, i: int, pivots: int, k: int | None):
        self.keys = batch.column("v_keys")[i].values
        self.rows = _floats(batch.column("v_data"), i, np.float32).reshape(len(self.keys), -1)
        self.starts = _floats(batch.column("starts"), i, np.int64)
        self.ends = np.append(self.starts[1:], len(self.keys))
        self.low, self.high = (_floats(batch.column(c), i).reshape(len(self.starts), pivots) for c in ("lows", "highs"))
        self.norms = norms(self.rows)
        self.taken = None
        if k is not None and not (taken := _floats(batch.column("copies"), i, np.int64) < k).all():
            self.taken = taken


class _Queries:
    """A pack of queries, each with the squared distance (``limit``) beyond which nothing is searched."""

    def __init__(self, keys: pa.Array, data: bytes, limit: np.ndarray, points: np.ndarray):
        self.keys = keys
        self.rows = np.frombuffer(data, np.float32).reshape(len(keys), -1)
        self.norms = norms(self.rows)
        self.far = _distances(self.rows, points)
        self.most = self.norms.max(initial=0.0)
        # Products are made in 32 bits, where the squares are in range.
        self.kind, self.floor = (np.float32, -1e30) if self.most < 1e25 else (np.float64, -1e300)
        self.left = np.column_stack([-2.0 * self.rows.astype(self.kind), np.ones((len(keys), 2), self.kind)])
        self.lower(limit)

    def lower(self, limit: np.ndarray) -> None:
        self.limit = limit
        radius = np.sqrt(limit) + SLACK
        self.least, self.greatest = np.ascontiguousarray((self.far - radius[:, None]).T), np.ascontiguousarray((self.far + radius[:, None]).T)
        self.left[:, -1] = np.maximum(self.norms - limit, self.floor)

    def reaching(self, vectors: _Vectors, block: int) -> np.ndarray:
        return np.flatnonzero(((self.least <= vectors.high[block][:, None]) & (self.greatest >= vectors.low[block][:, None])).all(axis=0))

    def near(self, vectors: _Vectors) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(numbers of queries, numbers of vectors, scores) of the pairs within the limits, and few others.

        The product form is off by rounding only, for which it is given room; what may be a hit is measured again from the differences.
        """
        dims = self.rows.shape[1]
        top = vectors.norms.max(initial=0.0)
        room = 2e-7 * (dims + 2) * (1.0 + top + self.most)
        kind = self.kind if top < 1e25 else np.float64
        right = np.column_stack([vectors.rows, np.ones((len(vectors.rows), 2), np.float32)]).astype(kind)
        right[:, -2] = vectors.norms - room
        step = max(1, CELLS // dims)
        cells = len(self.rows) * int((vectors.ends - vectors.starts).max(initial=0))
        product, below = np.empty(cells, np.result_type(self.left, right)), np.empty(cells, bool)
        for block, (start, end) in enumerate(zip(vectors.starts, vectors.ends)):
            rows = self.reaching(vectors, block)
            if not len(rows):
                continue
            at = np.arange(start, end)
            if vectors.taken is not None:
                at = at[vectors.taken[start:end]]
            some = right[start:end] if len(at) == end - start else right[at]
            left = self.left if len(rows) == len(self.left) else self.left[rows]
            n = len(rows) * len(at)
            np.matmul(left, some.T, out=product[:n].reshape(len(rows), len(at)))
            np.less_equal(product[:n], 0, out=below[:n])
            found = _set(below[:n])
            for i in range(0, len(found), step):
                q, v = np.divmod(found[i : i + step], len(at))
                q, v = rows[q], at[v]
                yield q, v, squared(vectors.rows[v], self.rows[q])


class _Best:
    """The best ``k`` vectors of each query of a pack among those met so far; queries with the same key share them."""

    def __init__(self, queries: _Queries, k: int):
        self.queries, self.k = queries, k
        names = queries.keys.dictionary_encode()
        self.names, self.codes = names.dictionary, names.indices.fill_null(-1).to_numpy(zero_copy_only=False)
        self.held: list[pa.Table] = []
        self.size = self.cut_at = 0

    def meet(self, vectors: _Vectors) -> Iterator[pa.RecordBatch]:
        for q, v, score in self.queries.near(vectors):
            code = self.codes[q]
            keep = np.flatnonzero((score <= self.queries.limit[q]) & (code >= 0))
            if len(keep):
                self.held.append(pa.table({"code": code[keep], "score": score[keep], "key": vectors.keys.take(pa.array(v[keep]))}))
                self.size += len(keep)
            if self.size > self.cut_at:
                self.cut()
                if self.size > HELD_ROWS:
                    yield from self.found()
                    self.held, self.size, self.cut_at = [], 0, 0

    def cut(self) -> None:
        """Lets go of what is not among the best, and lowers the limits of queries that have ``k``."""
        if not self.held:
            return
        found = pa.concat_tables(self.held)
        order = pc.sort_indices(found, [("code", "ascending"), ("score", "ascending"), ("key", "ascending")], null_placement="at_start").to_numpy()
        code = found.column("code").to_numpy()[order]
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(first, np.diff(first, append=len(code)))
        last = np.flatnonzero(place == self.k - 1)
        if len(last):
            known = np.full(len(self.names) + 1, np.inf)
            known[code[last]] = found.column("score").to_numpy()[order[last]] + ROUNDING
            self.queries.lower(np.minimum(self.queries.limit, known[self.codes]))
        self.held = [found.take(pa.array(order[place < self.k]))]
        self.size = self.held[0].num_rows
        self.cut_at = 2 * self.size

    def found(self) -> Iterator[pa.RecordBatch]:
        self.cut()
        for table in self.held:
            for rows in table.combine_chunks().to_batches():
                yield pa.RecordBatch.from_arrays([self.names.take(rows.column(0)), rows.column(2), rows.column(1)], names=["query_key", "key", "score"])


def _asked(index: PivotIndex, queries: DataFrame, query_key: str, vector: str) -> tuple[DataFrame, np.ndarray]:
    """Packs of queries, and the sizes of their buckets."""
    rows = queries.select(F.col(query_key).alias("key"), F.col(vector).alias("vector"))
    packs, _, sizes = _packed(rows, index.pivots, index.width, "query")
    return packs.select("no", "bucket", F.col("keys").alias("q_keys"), F.col("data").alias("q_data"), F.col("low").alias("q_low"), F.col("high").alias("q_high")), sizes


def _met(index: PivotIndex, packs: DataFrame, sizes: np.ndarray, radius: Column) -> DataFrame:
    """Packs of queries beside the packs of vectors they can reach, in a grid of tasks.

    ``radius`` is the greatest of a pack. Each task holds a bounded share of the vectors and reads packs of queries one after the other.
    """
    row_bytes = 4 * index.pivots.shape[1]
    want = TASKS_PER_CORE * packs.sparkSession.sparkContext.defaultParallelism
    v_packs, q_packs = (int(max(1, -(-n.sum() // PACK_ROWS))) for n in (index.sizes, sizes))
    down = min(q_packs, max(want, -(-int(sizes.sum()) * row_bytes // SHARE_BYTES)))
    across = min(v_packs, max(-(-int(index.sizes.sum()) * row_bytes // SHARE_BYTES), -(-want // down)))
    vectors = index.packs.select(F.col("keys").alias("v_keys"), F.col("data").alias("v_data"), "low", "high", "starts", "lows", "highs", "copies").repartition(across)
    asked = packs.withColumn("q_least", F.transform("q_low", lambda x: x - radius)).withColumn("q_most", F.transform("q_high", lambda x: x + radius)).repartition(down)
    each = range(len(index.pivots))
    meets = F.lit(True)
    for i in each:
        meets &= (F.get("q_least", F.lit(i)) <= F.get("high", F.lit(i))) & (F.get("q_most", F.lit(i)) >= F.get("low", F.lit(i)))
    return asked.join(vectors.hint("shuffle_replicate_nl"), meets)


def _compared(points: np.ndarray, batches: Iterator[pa.RecordBatch], limits, k: int | None) -> Iterator[tuple[int, _Queries, _Vectors]]:
    """Pairs of packs of a task; a pack of queries is made ready once while it goes on meeting vectors."""
    no, queries = None, None
    for batch in batches:
        for i in range(batch.num_rows):
            if (own := batch.column("no")[i].as_py()) != no:
                no = own
                keys = batch.column("q_keys")[i].values
                queries = _Queries(keys, batch.column("q_data")[i].as_py(), limits(batch, i, len(keys)), points)
            yield no, queries, _Vectors(batch, i, len(points), k)


def _schema(queries: DataFrame, query_key: str, index: PivotIndex) -> T.StructType:
    return T.StructType([T.StructField("query_key", queries.schema[query_key].dataType), T.StructField("key", index.key_type), T.StructField("score", T.DoubleType())])


def within(index: PivotIndex, queries: DataFrame, distance: float, query_key: str = "query_key", vector: str = "embedding") -> DataFrame:
    """All vectors at a squared distance of at most ``distance`` from each query: (query_key, key, score).

    Distances are rounded to nine places before they are compared. There is no cap per query; rows are
    given out as they are found. Neither side is copied to the other by shuffle.
    """
    if distance < 0:
        raise ValueError("the distance must not be negative")
    points, limit, most = index.pivots, distance + ROUNDING, np.round(distance, 9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, asked, vectors in _compared(points, batches, lambda _b, _i, n: np.full(n, limit), None):
            for q, v, score in asked.near(vectors):
                keep = score <= most
                if keep.any():
                    columns = [asked.keys.take(pa.array(q[keep])), vectors.keys.take(pa.array(v[keep])), pa.array(score[keep])]
                    yield pa.RecordBatch.from_arrays(columns, names=["query_key", "key", "score"])

    packs, sizes = _asked(index, queries, query_key, vector)
    return _met(index, packs, sizes, F.lit(float(np.sqrt(limit)) + SLACK)).mapInArrow(run, _schema(queries, query_key, index))


def _bounded(index: PivotIndex, packs: DataFrame, k: int) -> DataFrame:
    """Packs of queries with a limit of each query, and its greatest root: the ``k``-th distance in the pack of vectors where the bucket of most begins."""

    def bound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n = len(batch.column("q_keys")[i].values)
                limit = np.full(n, np.inf)
                data = batch.column("v_data")[i].as_py() or b""
                asked = np.frombuffer(batch.column("q_data")[i].as_buffer(), np.float32).reshape(n, -1)
                vectors = np.frombuffer(data, np.float32).reshape(-1, asked.shape[1])
                if len(vectors) >= k:
                    q_norms, v_norms = norms(asked), norms(vectors)
                    room = 2e-7 * (asked.shape[1] + 2) * (1.0 + q_norms.max() + v_norms.max())
                    kind = np.float32 if q_norms.max() + v_norms.max() < 1e25 else np.float64
                    right, squares = vectors.astype(kind).T, v_norms.astype(kind)
                    for start in range(0, n, BLOCK_ROWS):
                        own = slice(start, start + BLOCK_ROWS)
                        rough = squares - 2 * (asked[own].astype(kind) @ right)
                        limit[own] = np.maximum(np.partition(rough, k - 1, axis=1)[:, k - 1] + q_norms[own] + room, 0.0) + ROUNDING
                rows = batch.slice(i, 1).select(["no", "q_keys", "q_data", "q_low", "q_high"])
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([limit.tobytes()], pa.binary()), pa.array([np.sqrt(limit.max()) + SLACK])], names=[*rows.schema.names, "q_limit", "q_radius"])

    begins = index.packs.select(F.explode("homes").alias("bucket"), F.col("no").alias("v_no"))  # at most PIVOTS x RINGS rows
    firsts = index.packs.filter(F.size("homes") > 0).select(F.col("no").alias("v_no"), F.col("data").alias("v_data"))
    schema = T.StructType([*packs.drop("bucket").schema.fields, T.StructField("q_limit", T.BinaryType()), T.StructField("q_radius", T.DoubleType())])
    return packs.join(F.broadcast(begins), "bucket", "left").join(firsts.hint("shuffle_hash"), "v_no", "left").mapInArrow(bound, schema)


def nearest(index: PivotIndex, queries: DataFrame, k: int = 5, query_key: str = "query_key", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors of each query: (query_key, key, score, rank); ties go to the smaller key.

    A first search in one pack of vectors near to a pack of queries bounds each query's distance to its k-th neighbour; the
    second is a search within that distance, which falls as vectors are met. A task passes on ``k`` rows per query.
    """
    points = index.pivots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, best = None, None
        for no, asked, vectors in _compared(points, batches, lambda b, i, _n: _floats(b.column("q_limit"), i), k):
            if no != last:
                if best is not None:
                    yield from best.found()
                last, best = no, _Best(asked, k)
            yield from best.meet(vectors)
        if best is not None:
            yield from best.found()

    packs, sizes = _asked(index, queries, query_key, vector)
    met = _met(index, _bounded(index, packs, k), sizes, F.col("q_radius"))
    found = met.mapInArrow(run, _schema(queries, query_key, index))
    return first_n(found, ["query_key"], [F.col("score"), F.col("key")], k)


def compared_share(index: PivotIndex, queries: DataFrame, distance: float, query_key: str = "query_key", vector: str = "embedding") -> DataFrame:
    """How much of all pairs of queries and vectors ``within`` measures: n_pairs, n_compared, share."""
    points, limit = index.pivots, distance + ROUNDING

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, asked, vectors in _compared(points, batches, lambda _b, _i, n: np.full(n, limit), None):
            sizes = vectors.ends - vectors.starts
            yield pa.RecordBatch.from_pydict({"n": pa.array([sum(len(asked.reaching(vectors, block)) * int(size) for block, size in enumerate(sizes))], pa.int64())})

    packs, sizes = _asked(index, queries, query_key, vector)
    met = _met(index, packs, sizes, F.lit(float(np.sqrt(limit)) + SLACK))
    compared = met.mapInArrow(count, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_compared"))
    asked = F.col(vector)
    usable = asked.isNotNull() & (F.size(asked) > 0) & F.forall(asked, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    pairs = queries.filter(usable).agg((F.count(F.lit(1)) * int(index.sizes.sum())).alias("n_pairs"))
    return pairs.withColumn("n_compared", compared.scalar()).withColumn("share", F.try_divide("n_compared", "n_pairs"))
