"""Near-duplicates by min-max hashing.

Under each of a number of permutations the smallest and the largest value of a
document's shingles are kept, two signature values for one evaluation. Values are
banded; documents that agree in a band are candidates. With 35 bands of 5 values a
pair at similarity 0.8 is missed once in a million.

Documents with one and the same set are one node. In each band the members are
first compared with the smallest one only, and joined. Then whatever a band holds in
more than one component is compared in full: in bands of few members pairs whose
one-bit sketches (a bit of each signature value) differ too much are left out; larger
bands are cut into blocks, and a task that holds two blocks counts the shared shingles
of all their pairs and returns only which components meet. So a large group neither
meets in one task nor is written out as pairs, and no link between components is lost.
Comparisons are on the full sets of 64-bit shingle hashes.

NULL and empty texts have an empty set and are linked with nothing. Rows that share
a doc_id are one document. A row with a NULL doc_id stands alone, without
component, and stays. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as w
from codeloom.llm.graph import components, smallest_places
from codeloom.sources.tables import saved

BANDS, ROWS = 35, 5
_PERMUTATIONS = -(-BANDS * ROWS // 2)
_random = np.random.default_rng(4_711)
_FLIP = _random.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint32)
_TIMES = _random.integers(0, 1 << 32, _PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_BAND = w.mixed(_random.integers(1, 1 << 63, BANDS, dtype=np.uint64))
_STEP = np.uint64(0x9FB21C651E98DF25)
SKETCH = 3  # 64-bit words of sketch
#: Sketches of a pair at similarity 0.8 differ in a tenth of their bits; this is 5.5 standard errors more.
MOST_DIFFERENT = int(BANDS * ROWS * 0.1 + 5.5 * (BANDS * ROWS * 0.09) ** 0.5)
FEW = 16  # members of a band that are joined pair by pair
BLOCK = 512
COLUMNS = 4096


def shingles(data: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, repeats included, and where each text's begin."""
    starts, ends, first = w.cut(data, bounds, w.NON_SPACE)
    hashed = w.hashes(data, starts, ends, lower=True)
    n_words = np.diff(first)
    at, found = w.windows(hashed, first, size)
    owner = np.repeat(np.arange(len(n_words)), n_words)[at]
    short = np.flatnonzero((n_words > 0) & (n_words < size))  # the whole sequence is the one shingle
    whole = n_words[short].astype(np.uint64)
    for step in range(size - 1):
        more = n_words[short] > step
        whole[more] = whole[more] * _STEP + hashed[first[:-1][short[more]] + step]
    owner, found = np.concatenate([owner, short]), np.concatenate([found, w.mixed(whole)])
    order = np.argsort(owner, kind="stable")
    return found[order], np.searchsorted(owner[order], np.arange(len(n_words) + 1))


def signatures(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys (texts x BANDS) and sketches (texts x SKETCH) of texts that all have shingles."""
    low = np.empty((2 * _PERMUTATIONS, len(first) - 1), np.uint32)
    narrow = (found >> np.uint64(32)).astype(np.uint32)
    heads = first[:-1]
    for p in range(_PERMUTATIONS):
        turned = (narrow ^ _FLIP[p]) * _TIMES[p]
        low[p] = np.minimum.reduceat(turned, heads)
        low[_PERMUTATIONS + p] = np.maximum.reduceat(turned, heads)
    keys = np.repeat(_BAND[:, None], low.shape[1], axis=1)
    for r in range(ROWS):
        keys = w.mixed(keys * _STEP + low[r * BANDS : (r + 1) * BANDS].astype(np.uint64))
    bits = np.zeros((low.shape[1], SKETCH * 64), np.uint8)
    bits[:, : BANDS * ROWS] = ((low[: BANDS * ROWS] >> np.uint32(7)) & np.uint32(1)).T
    return keys.T, np.packbits(bits, axis=1).view(np.int64)


def _distinct(found: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles text by text."""
    parts = [np.unique(found[a:b]) for a, b in zip(first[:-1].tolist(), first[1:].tolist())]
    return np.concatenate(parts) if parts else found, np.append(0, np.cumsum([len(p) for p in parts])).astype(np.int64)


def _print_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in w.chunks(batch.column(1)):
                found, first = _distinct(*shingles(data, bounds, size))
                n = np.diff(first)
                full = np.flatnonzero(n)
                sums = np.zeros((2, len(n)), np.uint64)
                sketch = np.zeros((len(n), SKETCH), np.int64)
                bands: list = [None] * len(n)
                if len(full):
                    heads = np.append(first[full], first[-1])
                    sums[0, full] = np.add.reduceat(found, heads[:-1])
                    sums[1, full] = np.add.reduceat(w.mixed(found ^ _STEP), heads[:-1])
                    offsets = np.zeros(len(n) + 1, np.int32)
                    offsets[1:] = np.cumsum(n > 0) * BANDS
                    keys, sketch[full] = signatures(found, heads)
                    bands = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(begin, end - begin),
                        "n_shingles": pa.array(n),
                        "f1": pa.array(sums[0].view(np.int64)),
                        "f2": pa.array(sums[1].view(np.int64)),
                        **{f"s{k}": pa.array(sketch[:, k]) for k in range(SKETCH)},
                        "bands": bands if isinstance(bands, pa.Array) else pa.array(bands, pa.list_(pa.int64())),
                    }
                )
        w.release()

    return run


def _set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, bounds in w.chunks(batch.column(1)):
                found, first = _distinct(*shingles(data, bounds, size))
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_pydict({"node": batch.column(0).slice(begin, end - begin), "shingles": lists})
        w.release()

    return run


def similar(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets share at least ``percent`` of their union."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    n_a, n_b = F.size("_a"), F.size("_b")
    close = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    shared = F.size(F.array_intersect("_a", "_b"))
    linked = F.when(close, 100 * shared >= percent * (n_a + n_b - shared))
    return pairs.join(left, "a").join(right, "b").filter(linked).select("a", "b")


def _meeting(percent: int):
    """Links between components within two blocks of a band, as spanning edges (a, b) of their roots."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["side"] != 2], rows[rows["side"] != 1]
        both = pd.concat([left, right])
        sets = [np.asarray(x) for x in both["shingles"]]
        size = np.array([len(x) for x in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        _, place, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        twice = seen > 1
        column = (np.cumsum(twice) - 1)[place]
        keep = twice[place]
        owner, column = owner[keep], column[keep]
        by = np.argsort(column, kind="stable")
        owner, column = owner[by], column[by]
        n = len(left)
        shared = np.zeros((n, len(right)), np.float32)
        for start in range(0, int(twice.sum()), COLUMNS):
            a, b = np.searchsorted(column, [start, start + COLUMNS])
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[owner[a:b], column[a:b] - start] = 1
            shared += has[:n] @ has[n:].T
        common = np.rint(shared).astype(np.int64)
        root = both["root"].to_numpy()
        linked = (100 * common >= percent * (size[:n, None] + size[None, n:] - common)) & (root[:n, None] != root[None, n:])
        names, number = np.unique(root, return_inverse=True)
        x, y = np.nonzero(linked)
        joined = smallest_places(len(names), number[:n][x], number[n:][y])
        moved = np.flatnonzero(joined != np.arange(len(names)))
        return pd.DataFrame({"a": names[moved], "b": names[joined[moved]]})

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, for every row."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), w.text_of(docs).alias("text"))
    prints = saved(
        texts.mapInArrow(_print_batches(size), "doc_id bigint, n_shingles bigint, f1 bigint, f2 bigint, s0 bigint, s1 bigint, s2 bigint, bands array<bigint>"), "prints"
    )
    linkable = prints.filter("doc_id IS NOT NULL AND n_shingles > 0")
    same = ["f1", "f2", "n_shingles"]
    classes = saved(linkable.groupBy(*same).agg(F.min("doc_id").alias("node")), "classes")
    members = saved(linkable.select("doc_id", *same).join(classes, same).select("doc_id", "node").distinct(), "members")

    leading = linkable.join(classes.withColumnRenamed("node", "doc_id"), ["doc_id", *same], "left_semi").withColumnRenamed("doc_id", "node")
    keys = leading.select("node", "n_shingles", F.explode("bands").alias("key"))
    shared = saved(keys.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("_last")).filter("leader <> _last").drop("_last"), "shared-keys")
    buckets = saved(keys.join(shared, "key"), "buckets")

    followers = buckets.filter("node <> leader").groupBy("node", "leader").agg(F.count(F.lit(1)).alias("_n"))
    first = saved(followers.groupBy("node").agg(F.max_by("leader", F.struct("_n", -F.col("leader"))).alias("a")).select("a", F.col("node").alias("b")), "first-pairs")
    wanted = buckets.select(F.col("node").alias("doc_id")).distinct().hint("shuffle_hash")
    sets = saved(texts.join(wanted, "doc_id", "left_semi").mapInArrow(_set_batches(size), "node bigint, shingles array<bigint>"), "sets")
    links = similar(first, sets, percent)
    # Rows that share a doc_id but not a text are one document.
    links = links.union(members.filter("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b")))
    joined = components(links)

    placed = saved(buckets.join(joined, "node", "left").select("key", "node", "n_shingles", F.coalesce("root", "node").alias("root")), "placed")
    open_ = placed.groupBy("key").agg(F.min("root").alias("_low"), F.max("root").alias("_high"), F.count(F.lit(1)).alias("_m"))
    open_ = saved(open_.filter("_low <> _high").select("key", "_m"), "open-keys")
    loose = saved(placed.join(open_, "key"), "loose")
    few = loose.filter(F.col("_m") <= FEW).join(leading.select("node", "s0", "s1", "s2").dropDuplicates(["node"]), "node")
    side = lambda x: few.select("key", *[F.col(c).alias(f"{x}_{c}") for c in ("node", "n_shingles", "root", "s0", "s1", "s2")])
    differ = " + ".join(f"bit_count(a_s{k} ^ b_s{k})" for k in range(SKETCH))
    close = f"a_node < b_node AND a_root <> b_root AND 100 * least(a_n_shingles, b_n_shingles) >= {percent} * greatest(a_n_shingles, b_n_shingles) AND {differ} <= {MOST_DIFFERENT}"
    pairs = side("a").join(side("b"), "key").filter(close).select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    more = similar(pairs.join(first, ["a", "b"], "left_anti"), sets, percent)
    roots = loose.select("node", "root").distinct()
    more = more.join(roots.withColumnsRenamed({"node": "a", "root": "_a"}), "a").join(roots.withColumnsRenamed({"node": "b", "root": "_b"}), "b")
    more = more.select(F.col("_a").alias("a"), F.col("_b").alias("b"))

    blocks = F.ceil(F.col("_m") / BLOCK).cast("int")
    many = loose.filter(F.col("_m") > FEW).withColumn("_n", blocks).withColumn("_i", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    many = many.join(sets, "node").select("key", "root", "shingles", "_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_j"))
    cells = [many.select("key", F.col(i).alias("i"), F.col(j).alias("j"), "root", "shingles", F.lit(s).alias("side")) for i, j, s in (("_i", "_j", 1), ("_j", "_i", 2))]
    # A block with itself stands once on either side; of two blocks one order is enough.
    met = cells[0].filter("i <= j").union(cells[1].filter("i <= j")).groupBy("key", "i", "j").applyInPandas(_meeting(percent), "a bigint, b bigint")
    merged = components(more.union(met))

    step = merged.select(F.col("node").alias("root"), F.col("root").alias("_to"))
    final = joined.join(step, "root", "left").select("node", F.coalesce("_to", "root").alias("component_id"))
    alone = merged.join(joined.select("node"), "node", "left_anti").select("node", F.col("root").alias("component_id"))
    # Every row of a class has the component of its first document.
    found = final.union(alone).withColumnRenamed("node", "doc_id")
    found = saved(found, "found")
    out = prints.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents less all but one of each group; columns as they come.

    Rows that share a doc_id are one document, of which one row stays: that with the least digest of its
    text, and of its columns if the texts are equal, so that reruns agree. Rows without id, text or words
    are linked with nothing and stay, NULL ids all of them.
    """
    found = near_duplicates(docs, size, percent)
    gone = saved(found.filter("NOT kept").select("doc_id").distinct(), "gone")
    left = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1")
    if repeated.isEmpty():
        return left
    order = F.struct(F.sha2(w.text_of(docs).cast("binary"), 256).alias("t"), F.xxhash64(*docs.columns).alias("r"))
    chosen = left.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), order).alias("_row"))
    return chosen.select("_row.*").union(left.filter("doc_id IS NULL"))
