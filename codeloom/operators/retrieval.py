"""Embedding, exact nearest neighbours and context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.functions.text import pinned
from codeloom.operators.ranking import first_n
from codeloom.operators.tokens import tokens
from codeloom.session import fits
from codeloom.sources.tables import saved

BROADCAST_QUERIES = 16_384
PACK_ROWS = 1024
HELD_ROWS = 500_000
CONTEXT_HEADER = "# Relevant context from project:\n"


def hash_buckets(text: Column, dims: int) -> Column:
    """Bucket of every token, by the first 16 bits of its MD5."""
    return F.transform(tokens(text), lambda t: F.pmod(F.conv(F.substring(F.md5(t), 1, 4), 16, 10).cast("int"), F.lit(dims)))


def unit_vectors(dims: int):
    """Arrow UDF: bucket lists to vectors of unit length, zero for no tokens."""

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for buckets in batches:
            out = []
            for row in buckets:
                counts = np.bincount(np.asarray(row, dtype=np.int64), minlength=dims).astype(np.float64)
                norm = np.sqrt((counts * counts).sum())
                out.append((counts / norm if norm else counts).astype(np.float32))
            yield pd.Series(out)

    encode.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(encode, T.ArrayType(T.FloatType()))


def embed_text(texts: DataFrame, text: str = "text", dims: int = 64, model: Callable[[Column], Column] | None = None) -> DataFrame:
    """Adds ``embedding``. ``model`` maps a text column to a vector column, for
    instance an iterator pandas UDF round a user's model; without it, tokens are
    hashed to ``dims`` buckets and the counts scaled to unit length.
    """
    vector = model(F.col(text)) if model else unit_vectors(dims)(hash_buckets(F.col(text), dims))
    return pinned(texts, embedding=vector)


def _packed(vectors: DataFrame, key: str, vector: str, prefix: str) -> DataFrame:
    """One row per ``PACK_ROWS`` vectors: their keys, and their values as bytes."""
    schema = T.StructType(
        [
            T.StructField(f"{prefix}_keys", T.ArrayType(vectors.schema[key].dataType)),
            T.StructField(f"{prefix}_data", T.BinaryType()),
        ]
    )

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), PACK_ROWS):
                part = batch.iloc[at : at + PACK_ROWS]
                data = np.stack(part[vector].to_numpy()).astype(np.float32)
                yield pd.DataFrame({f"{prefix}_keys": [part[key].tolist()], f"{prefix}_data": [data.tobytes()]})

    return vectors.select(key, vector).filter(F.col(vector).isNotNull()).mapInPandas(pack, schema)


def norms(rows: np.ndarray) -> np.ndarray:
    return (rows.astype(np.float64) ** 2).sum(axis=1)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances row by row, to nine places."""
    return np.round(((a.astype(np.float64) - b) ** 2).sum(axis=1), 9)


def slack(q_norms: np.ndarray, v_norms: np.ndarray) -> float:
    """More than what rounding to 32 bits can take from a distance in product form."""
    return 1e-5 * (1.0 + v_norms.max(initial=0.0) + q_norms.max(initial=0.0))


def products(queries: np.ndarray, vectors: np.ndarray, v_norms: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    """Squared distances without the norms of the queries, and with ``more`` per query, by one product."""
    more = np.zeros(len(queries)) if more is None else more
    left = np.column_stack([-2.0 * queries, np.ones(len(queries)), more]).astype(np.float32)
    return left @ np.column_stack([vectors, v_norms, np.ones(len(vectors))]).astype(np.float32).T


def reached(queries: np.ndarray, q_norms: np.ndarray, vectors: np.ndarray, v_norms: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the pairs of a query and a vector whose squared distance may be within the query's ``limit``, and few others.

    The product form is off by rounding only; callers measure these pairs again from the differences.
    """
    rest = np.maximum(q_norms - limit - slack(q_norms, v_norms), -1e30)  # a limit may be infinite
    return np.divmod(np.flatnonzero(products(queries, vectors, v_norms, rest) <= 0), len(vectors))


class Best:
    """The best ``k`` vectors for each query of a pack, among those met so far.

    ``limit`` is the squared distance beyond which a vector cannot belong to them; it falls
    as vectors are met, so that most blocks are only multiplied and compared with it.
    """

    def __init__(self, q_keys, queries: np.ndarray, k: int, limit: np.ndarray | None = None):
        self.k, self.queries, self.norms = k, queries, norms(queries)
        self.codes, self.names = pd.factorize(_objects(q_keys))  # a key may come twice; a NULL has no place
        self.limit = np.full(len(queries), np.inf) if limit is None else limit
        self.held: list[pd.DataFrame] = []
        self.size = self.cut_at = 0

    def meet(self, v_keys, vectors: np.ndarray, rows: np.ndarray | None = None) -> None:
        """Takes a block of vectors into account, for the queries ``rows`` alone if given."""
        at = np.arange(len(self.queries)) if rows is None else rows
        if not len(at) or not len(vectors):
            return
        v_norms = norms(vectors)
        limit = self.limit[at]
        if self.k < len(vectors) and len(free := np.flatnonzero(np.isinf(limit))):
            rough = self.norms[at[free], None] + products(self.queries[at[free]], vectors, v_norms)
            limit[free] = np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack(self.norms[at], v_norms)
        q_at, v_at = reached(self.queries[at], self.norms[at], vectors, v_norms, limit)
        if not len(q_at):
            return
        scores = squared(vectors[v_at], self.queries[at[q_at]])
        self.held.append(pd.DataFrame({"code": self.codes[at[q_at]], "key": _objects(v_keys)[v_at], "score": scores}))
        self.size += len(q_at)
        if self.size > self.cut_at:
            self.cut()

    def cut(self) -> None:
        """Lets go of what is not among the best ``k``, and lowers the limit of queries that have ``k``."""
        if not self.held:
            return
        found = pd.concat(self.held)
        found = found[found["code"] >= 0].sort_values(["code", "score", "key"], kind="stable")
        found = found.groupby("code", sort=False).head(self.k)
        full = found.groupby("code")["score"].agg(["size", "max"])
        full = full[full["size"] == self.k]
        known = np.full(len(self.names) + 1, np.inf)
        known[full.index.to_numpy()] = full["max"].to_numpy() + 1e-9  # scores are rounded to nine places
        self.limit = np.minimum(self.limit, known[self.codes])
        self.held, self.size = [found], len(found)
        self.cut_at = 2 * self.size

    def found(self) -> pd.DataFrame | None:
        self.cut()
        if not self.size:
            return None
        best = self.held[0]
        return pd.DataFrame({"query_key": self.names[best["code"]], "key": best["key"].to_numpy(), "score": best["score"].to_numpy()})


def _objects(values) -> np.ndarray:
    out = np.empty(len(values), object)
    out[:] = list(values)
    return out


def _unpacked(keys, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of a pack, without those that are not finite."""
    rows = np.frombuffer(data, dtype=np.float32).reshape(len(keys), -1)
    finite = np.isfinite(rows).all(axis=1)
    return _objects(keys)[finite], rows[finite]


def _filled(held: dict[int, Best]) -> Iterator[pd.DataFrame]:
    return (found for best in held.values() if (found := best.found()) is not None)


def _nearest_in_task(k: int):
    """Best ``k`` per query among the vectors of a task.

    A pack of queries keeps about ``k`` rows per query, and all packs are passed on and
    begun anew when ``HELD_ROWS`` have gathered, so a task holds a
    bounded number of rows however many vectors and queries it sees.
    """

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, Best] = {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.q_no not in held:
                    if sum(b.size for b in held.values()) > HELD_ROWS:
                        yield from _filled(held)
                        held.clear()
                    held[row.q_no] = Best(*_unpacked(row.q_keys, row.q_data), k)
                held[row.q_no].meet(*_unpacked(row.v_keys, row.v_data))
        yield from _filled(held)

    return search


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "key", query_key: str = "query_key",
    vector: str = "embedding", broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Exact ``k`` nearest vectors of every query by squared L2 distance.

    Gives (query_key, key, score, rank); ties go to the smaller key. Both sides
    are packed into blocks; a block of vectors meets every block of queries, and a
    task passes on ``k`` rows per query, not the pairs. Up to ``broadcast_queries``
    queries go to the vectors where they lie. Beyond that the blocks of both sides
    are written once, and each task of a grid reads its share of either: neither side is
    copied to the other by shuffle.
    """
    packs = _packed(vectors, key, vector, "v")
    blocks = _packed(queries, query_key, vector, "q").withColumn("q_no", F.monotonically_increasing_id())
    if fits(queries.select(query_key), broadcast_queries):
        met = packs.crossJoin(F.broadcast(blocks))
    else:
        met = saved(blocks, "query-blocks").crossJoin(saved(packs, "vector-blocks").hint("shuffle_replicate_nl"))
    schema = T.StructType(
        [
            T.StructField("query_key", queries.schema[query_key].dataType),
            T.StructField("key", vectors.schema[key].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    near = met.select("q_no", "v_keys", "v_data", "q_keys", "q_data").mapInPandas(_nearest_in_task(k), schema)
    return first_n(near, ["query_key"], [F.col("score"), F.col("key")], k)


def retrieve(
    chunks: DataFrame, queries: DataFrame, k: int = 5, key: str = "key", query_key: str = "query_key",
    broadcast_queries: int = BROADCAST_QUERIES,
) -> DataFrame:
    """Text and metadata of the ``k`` chunks nearest to every query, with score and rank.

    A key without a chunk drops out. With few queries the hits, ``k`` per query,
    go to the chunk table, which is then not shuffled.
    """
    near = nearest(chunks, queries, k, key, query_key, broadcast_queries=broadcast_queries)
    if fits(queries.select(query_key), broadcast_queries):
        near = F.broadcast(near)
    return chunks.drop("embedding").withColumnRenamed(key, "key").join(near, "key")


def assemble_context(found: DataFrame, queries: DataFrame, query_key: str = "query_key", code: str = "code") -> DataFrame:
    """``context``: header, the hit texts by rank, and the query's own code if any.

    A query has at most k hits, so the lists gathered here are that short.
    """
    texts = found.groupBy(query_key).agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("_hits"))
    joined = F.array_join(F.transform(F.coalesce("_hits", F.array().cast("array<struct<rank:int,text:string>>")), lambda h: h["text"]), "\n\n")
    own = F.when(F.coalesce(F.col(code), F.lit("")) != "", F.concat(F.lit("\n\n"), F.col(code))).otherwise("")
    return queries.join(texts, query_key, "left").withColumn("context", F.concat(F.lit(CONTEXT_HEADER), joined, own)).drop("_hits")
