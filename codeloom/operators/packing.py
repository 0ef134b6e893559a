"""Packing of token rows into full windows, and windows of tokens that cite their place in a text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions.text import BLANK

# Declared lengths of packed windows, and size and overlap of token chunks.
PACKED_LENGTH = 1024
CHUNK_TOKENS, CHUNK_OVERLAP = 256, 50

MARKER = re.compile(r"<\|[a-z]+\|>")
CHUNK_CHARS = 1 << 20  # texts are cut into tokens together up to this size
TOKEN_CHUNK = "struct<text:string,start:int,end:int,first_token:int,starts:array<int>,ends:array<int>>"


def shard_of(key: Column, shards: int) -> Column:
    """A shard that depends on the key alone, by the first 16 bits of its MD5."""
    return F.pmod(F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(shards))


class _Windows:
    """Windows of one shard that are open or done; what is left of a batch is carried to the next."""

    def __init__(self, length: int, separator: int | None):
        self.length, self.separator = length, separator
        self.start()

    def start(self) -> None:
        self.at = self.done = 0  # ids taken, and ids in windows that were given out
        self.ids = np.zeros(0, np.int32)
        self.row, self.place, self.start_of, self.size = (np.zeros(0, np.int64) for _ in range(4))
        self.keys: list = []

    def take(self, keys: list, values: np.ndarray, sizes: np.ndarray) -> None:
        """Rows of ids behind those taken; a separator stands between two rows."""
        apart = int(self.separator is not None)
        lead = np.full(len(sizes), apart, np.int64)
        if not self.at:
            lead[:1] = 0
        begins = np.cumsum(sizes + lead) - sizes + self.at
        if apart:
            values = np.insert(values, (np.cumsum(sizes) - sizes)[lead > 0], self.separator)
        # A row has a piece in every window it reaches into.
        filled = sizes > 0
        first, last = begins // self.length, (begins + sizes - 1) // self.length
        n = np.where(filled, last - first + 1, 0)
        row = np.repeat(np.arange(len(sizes)), n)
        window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        from_ = np.maximum(window * self.length, begins[row])
        to = np.minimum((window + 1) * self.length, (begins + sizes)[row])
        self.row = np.append(self.row, row + len(self.keys))
        self.place = np.append(self.place, from_)
        self.start_of = np.append(self.start_of, from_ - begins[row])
        self.size = np.append(self.size, to - from_)
        self.keys += keys
        self.ids = np.append(self.ids, values.astype(np.int32))
        self.at = int(self.done + len(self.ids))

    def give(self, shard: int, rest: bool, schema: pa.Schema) -> pa.RecordBatch | None:
        """The full windows, and with ``rest`` the one that is not."""
        n = -(-len(self.ids) // self.length) if rest else len(self.ids) // self.length
        if not n:
            return None
        end = min(n * self.length, len(self.ids))
        bounds = np.minimum(np.arange(n + 1) * self.length, end)
        window = self.done // self.length
        out = int(np.searchsorted(self.place, self.done + end))
        pieces = pa.StructArray.from_arrays(
            [pa.array([self.keys[i] for i in self.row[:out]], schema.field("pieces").type.value_type.field("key").type),
             pa.array(self.start_of[:out].astype(np.int32)), pa.array((self.place[:out] % self.length).astype(np.int32)), pa.array(self.size[:out].astype(np.int32))],
            fields=list(schema.field("pieces").type.value_type),
        )
        at = np.searchsorted(self.place[:out] // self.length, np.arange(window, window + n + 1)).astype(np.int32)
        columns = [
            pa.array(np.full(n, shard, np.int32)),
            pa.array(np.arange(window, window + n)),
            pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(self.ids[:end]), type=schema.field("input_ids").type),
            pa.array(np.diff(bounds).astype(np.int32)),
            pa.ListArray.from_arrays(pa.array(at), pieces, type=schema.field("pieces").type),
        ]
        # What goes on: open ids, open pieces and the rows these belong to.
        self.ids, self.done = self.ids[end:].copy(), self.done + end
        self.place, self.start_of, self.size, row = (x[out:].copy() for x in (self.place, self.start_of, self.size, self.row))
        held, self.row = np.unique(row, return_inverse=True)
        self.keys = [self.keys[i] for i in held]
        return pa.RecordBatch.from_arrays(columns, schema=schema)


def pack_sequences(
    rows: DataFrame, key: str, length: int = PACKED_LENGTH, separator: int | None = None, shards: int | None = None, ids: str = "input_ids"
) -> DataFrame:
    """Token rows behind each other, cut into windows of ``length`` ids.

    Gives (shard, window, input_ids, n_real, pieces). Rows are dealt to ``shards`` by key and packed
    in key order within their shard, so a rerun gives the same windows and no
    window is known to more than one task; each shard's last window may be shorter, all others are
    full. With ``separator``, that id stands between two rows. ``pieces`` says
    which ids of a window come from which row: key, start in the row, place in the window, size;
    a row may go on in the next window, and a row without ids has no piece. Rows that tie in
    the key follow each other in the order of their ids.
    """
    shards = shards or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(shard_of(F.col(key), shards).alias("_shard"), F.col(key).alias("_key"), F.col(ids).cast("array<int>").alias("_ids"))
    dealt = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", "_key", "_ids")
    piece = T.StructType([T.StructField("key", rows.schema[key].dataType), *(T.StructField(n, T.IntegerType()) for n in ("start", "at", "size"))])
    schema = T.StructType(
        [
            T.StructField("shard", T.IntegerType()),
            T.StructField("window", T.LongType()),
            T.StructField("input_ids", T.ArrayType(T.IntegerType())),
            T.StructField("n_real", T.IntegerType()),
            T.StructField("pieces", T.ArrayType(piece)),
        ]
    )
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, shard = _Windows(length, separator), None
        for batch in batches:
            of, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(2)
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values, at = lists.flatten().to_numpy(zero_copy_only=False), np.append(0, np.cumsum(sizes))
            edges = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), len(of)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if of[a] != shard:
                    if shard is not None and (last := open_.give(shard, True, arrow)) is not None:
                        yield last
                    open_.start()
                    shard = int(of[a])
                open_.take(batch.column(1).slice(a, b - a).to_pylist(), values[at[a] : at[b]], sizes[a:b])
                if (full := open_.give(shard, False, arrow)) is not None:
                    yield full
        if shard is not None and (last := open_.give(shard, True, arrow)) is not None:
            yield last

    return dealt.mapInArrow(pack, schema)


def packing_fill(packed: DataFrame, length: int = PACKED_LENGTH) -> DataFrame:
    """Windows, the ids in them, the room left empty, and the share that is filled."""
    n, real = F.count(F.lit(1)), F.coalesce(F.sum("n_real"), F.lit(0))
    return packed.agg(n.alias("n_windows"), real.alias("n_ids"), (n * length - real).alias("n_empty"), F.try_divide(real, n * length).alias("fill"))


@cache
def _kinds() -> np.ndarray:
    """Kind of every code point: 0 blank, 1 of a word, 2 a token by itself."""
    kinds = np.full(0x110000, 2, np.uint8)
    kinds[[i for i in range(0x110000) if chr(i).isalnum()]] = 1
    kinds[ord("_")] = 1
    kinds[[ord(c) for c in BLANK]] = 0
    return kinds


def token_spans(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the tokens in the texts put together, each text's first token, and its first character.

    Tokens are those of ``tokens.TOKEN``: words, single other characters, and markers
    as a whole. All texts are cut at once, as arrays of code points.
    """
    joined = "\n".join([*texts, ""])
    kinds = _kinds()[np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)]
    word = kinds == 1
    before, after = np.append(False, word[:-1]), np.append(word[1:], False)
    alone = kinds == 2
    starts, ends = np.flatnonzero(alone | (word & ~before)), np.flatnonzero(alone | (word & ~after)) + 1
    if "<|" in joined:
        marks = np.array([m.span() for m in MARKER.finditer(joined)], np.int64).reshape(-1, 2)
        inside = np.zeros(len(joined) + 1, np.int64)
        np.add.at(inside, marks[:, 0], 1)
        np.add.at(inside, marks[:, 1], -1)
        free = np.cumsum(inside)[starts] == 0
        starts, ends = np.sort(np.append(starts[free], marks[:, 0])), np.sort(np.append(ends[free], marks[:, 1]))
    base = np.append(0, np.cumsum([len(t) + 1 for t in texts])).astype(np.int64)
    return starts, ends, np.searchsorted(starts, base), base


def _chunked(texts: list[str], size: int, step: int) -> list[list[dict]]:
    starts, ends, first, base = token_spans(texts)
    out = []
    for i, text in enumerate(texts):
        own = slice(first[i], first[i + 1])
        s, e = starts[own] - base[i], ends[own] - base[i]
        n = len(s)
        chunks = []
        for at in range(0, max(n - size, 0) + step if n else 0, step):
            to = min(at + size, n)
            a, b = int(s[at]), int(e[to - 1])
            chunks.append({"text": text[a:b], "start": a, "end": b, "first_token": at, "starts": s[at:to], "ends": e[at:to]})
            if to == n:
                break
        out.append(chunks)
    return out


def chunk_tokens(texts: DataFrame, text: str = "text", size: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP, out: str = "chunks") -> DataFrame:
    """Adds windows of ``size`` tokens that share ``overlap`` tokens with the one before.

    A chunk has its text, the characters it covers (``start`` to ``end``, of the
    whole text), its first token's number, and the table of its tokens' places: starts and ends in
    the whole text. Each token is in a chunk; what lies between two chunks is blank.
    A text has chunks until its last token is covered; NULL and blank texts have none. Rows stay where they are.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be smaller than the chunk")
    schema = T.StructType([*texts.schema.fields, T.StructField(out, T.DataType.fromDDL(f"array<{TOKEN_CHUNK}>"))])
    arrow = to_arrow_schema(schema)
    place = texts.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = [t or "" for t in batch.column(place).to_pylist()]
            at = 0
            while at < len(given):
                to, chars = at + 1, len(given[at])
                while to < len(given) and chars + len(given[to]) <= CHUNK_CHARS:
                    chars += len(given[to])
                    to += 1
                chunks = pa.array(_chunked(given[at:to], size, size - overlap), arrow.field(out).type)
                yield pa.RecordBatch.from_arrays([*batch.slice(at, to - at).columns, chunks], schema=arrow)
                at = to

    return texts.mapInArrow(run, schema)
