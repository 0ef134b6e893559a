"""Token ids of a corpus in Simple-8b words.

A file row is a run of whole documents. Their ids lie in 64-bit words of 4
selector bits and 60 bits of ids, cut into blocks of ``BLOCK`` ids that are
coded by themselves, so that all blocks of a row are coded and decoded side by
side. An id of more than ``NARROW`` bits keeps its low bits in its slot; its high
bits are in the escape list of the row.

NULL and empty texts hold the end id alone. Repeated doc_ids keep all rows,
ordered by text; a NULL doc_id comes first. Empty tables give empty files and results.
"""

from __future__ import annotations

import itertools
import os
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm import words as w
from codeloom.session import shared_dir

BLOCK = 1024
NARROW = 15
#: Ids per word and bits per id by selector.
SLOTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15))
#: Bits of every narrow value.
_WIDTH = np.repeat(np.arange(NARROW + 1, dtype=np.uint8), [1, *(1 << k for k in range(NARROW))])
_PRINTED = (np.arange(256) > 32) & (np.arange(256) < 127)
MEMO_PIECES = 750_000  # pieces whose ids a worker remembers: half of them since the last change of generation
ROW_BYTES = 1 << 20
JOINED_BYTES = 1 << 12
AT_ONCE = 128  # texts given to the tokenizer in one call

FILE_SCHEMA = (
    "part int, piece int, doc_ids array<bigint>, counts binary, n bigint, words binary, block_at binary, escape_at binary, escape_high binary"
)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, first word of every block, places and high bits of the escapes."""
    ids = ids.astype(np.uint64)
    n_blocks = -(-len(ids) // BLOCK)
    escape_at = np.flatnonzero(ids >> np.uint64(NARROW))
    escape_high = (ids[escape_at] >> np.uint64(NARROW)).astype(np.uint32)
    low = np.zeros(n_blocks * BLOCK + 60, np.uint64)
    low[: len(ids)] = ids & np.uint64((1 << NARROW) - 1)
    # The slots of the widest id of the next n: the first selector whose n ids all fit wins.
    width = _WIDTH[low.astype(np.intp)]
    best = np.full(len(low), len(SLOTS) - 1, np.uint8)
    top, reach = width.copy(), 1
    limits = {}
    for count, _ in reversed(SLOTS):
        while reach < count:
            step = min(reach, count - reach)
            top[: len(top) - step] = np.maximum(top[: len(top) - step], top[step:])
            reach += step
        limits[count] = top.copy()
    for selector in range(len(SLOTS) - 1, -1, -1):
        count, bits = SLOTS[selector]
        best[limits[count] <= bits] = selector
    taken = np.array([count for count, _ in SLOTS], np.int64)
    # All blocks walk at once, a word each per step; slots beyond a block's end are passed over when read.
    at = np.arange(n_blocks, dtype=np.int64) * BLOCK
    ends = np.minimum(at + BLOCK, len(ids))
    starts, owners = [], []
    live = np.arange(n_blocks)
    while len(live):
        here = at[live]
        starts.append(here)
        owners.append(live)
        at[live] = here + taken[best[here]]
        live = live[at[live] < ends[live]]
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    order = np.argsort(start, kind="stable")
    start, owner = start[order], owner[order]
    chosen = best[start]
    out = chosen.astype(np.uint64) << np.uint64(60)
    for selector, (count, bits) in enumerate(SLOTS):
        rows = np.flatnonzero(chosen == selector)
        for slot in range(count):
            out[rows] |= low[start[rows] + slot] << np.uint64(slot * bits)
    return out, np.searchsorted(owner, np.arange(n_blocks)).astype(np.uint32), escape_at.astype(np.uint32), escape_high


def unpack(n: int, coded: np.ndarray, block_at: np.ndarray, escape_at: np.ndarray, escape_high: np.ndarray) -> np.ndarray:
    """The ``n`` ids again, all blocks together; slots beyond a block's end are passed over."""
    out = np.zeros(n, np.uint32)
    if not n:
        return out
    chosen = (coded >> np.uint64(60)).astype(np.int64)
    taken = np.array([count for count, _ in SLOTS], np.int64)[chosen]
    before = np.cumsum(taken) - taken
    block = np.repeat(np.arange(len(block_at)), np.diff(np.append(block_at.astype(np.int64), len(coded))))
    place = before - before[block_at.astype(np.int64)][block] + block * BLOCK
    end = np.minimum((block + 1) * BLOCK, n)
    for selector, (count, bits) in enumerate(SLOTS):
        rows = np.flatnonzero(chosen == selector)
        for slot in range(count):
            to = place[rows] + slot
            inside = to < end[rows]
            out[to[inside]] = ((coded[rows[inside]] >> np.uint64(slot * bits)) & np.uint64((1 << bits) - 1)).astype(np.uint32)
    out[escape_at] |= escape_high << np.uint32(NARROW)
    return out


_NONE = (np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32))


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of those keys that are in a sorted run, and which these are."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(len(keys), bool)
    place = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    hit = known[place] == keys
    return place[hit], hit


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of the ranges, one range after the other."""
    total = np.cumsum(size)
    return np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)


class Encoder:
    r"""The tokenizer, asked once for each piece of text.

    A text is cut before every space that a letter (ASCII or Latin-1) follows, before every ASCII
    mark or line end that follows an ASCII letter, and before a letter at the begin of a line if the line
    before does not end in a blank: byte-level rules that split words at ``' ?\p{L}+'``
    begin a token at these places, whatever stands around, so ids of the pieces put
    together are the ids of the text. Apostrophes, and marks that occur in added tokens, cut nothing.

    When half of ``MEMO_PIECES`` are known they become the older generation; of it, what
    is met again is taken over without asking, and the rest is forgotten at the next change.
    """

    def __init__(self, path: str):
        # One thread: a task has one core, and each thread more keeps memory of its own.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        # A character of a byte-level token stands for a byte; added tokens are ASCII.
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(token) for token in vocabulary]
        added = "".join(token.content for token in self.tokenizer.get_added_tokens_decoder().values())
        self.marks = np.array([chr(c) in string.punctuation + "\n" and chr(c) not in added + "'" for c in range(256)])
        self.older = (*_NONE, np.zeros(0, np.uint16))
        self.clear()

    def clear(self) -> None:
        """Known pieces in two sorted runs, the later one small: (hash, begin of its ids, number of ids)."""
        self.known = [_NONE] * 2
        self.flat = [np.zeros(0, np.uint16)]
        self.n_flat = 0

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of ids of each piece; -1 for a new one."""
        begin, size = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        for known in self.known:
            at, hit = _places(known[0], keys)
            begin[hit], size[hit] = known[1][at], known[2][at]
        return begin, size

    def turn(self) -> None:
        """A new generation; what is known becomes the older one."""
        to = np.searchsorted(self.known[0][0], self.known[1][0])
        self.older = (*(np.insert(a, to, b) for a, b in zip(*self.known)), np.concatenate(self.flat))
        self.clear()

    def recall(self, keys: np.ndarray) -> np.ndarray:
        """Takes over what the older generation knows of the pieces; says of which it does."""
        known, begin, size, flat = self.older
        at, hit = _places(known, keys)
        if hit.any():
            self.remember(keys[hit], flat[_ranges(begin[at], size[at])], size[at])
        return hit

    def remember(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray, order: np.ndarray | None = None) -> None:
        """Adds pieces in the order of their hashes; ``order`` is that of their ids, if another."""
        begin = self.n_flat + np.cumsum(size) - size
        if order is not None:
            placed = np.empty((2, len(keys)), np.int64)
            placed[:, order] = begin, size
            begin, size = placed
        self.flat.append(ids.astype(np.uint16 if len(self.bytes_of) <= 1 << 16 else np.uint32))
        self.n_flat += len(ids)
        to = np.searchsorted(self.known[1][0], keys)
        self.known[1] = tuple(np.insert(a, to, b.astype(a.dtype)) for a, b in zip(self.known[1], (keys, begin, size)))
        if len(self.known[1][0]) * 8 > len(self.known[0][0]):
            to = np.searchsorted(self.known[0][0], self.known[1][0])
            self.known = [tuple(np.insert(a, to, b) for a, b in zip(*self.known)), tuple(a[:0] for a in self.known[1])]
            self.flat = [np.concatenate(self.flat)]

    def ids_of(self, joined: list[bytes], alone: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces in a row, and how many are of each.

        Pieces that begin with a space and a letter are ``joined`` and encoded
        together; the bytes of the tokens tell them apart again.
        """
        ends = np.cumsum([len(piece) for piece in joined] + [len(piece) for piece in alone])
        cuts = np.searchsorted(ends[: len(joined)], np.arange(JOINED_BYTES, ends[len(joined) - 1] if joined else 0, JOINED_BYTES))
        cuts = [0, *np.unique(cuts).tolist(), len(joined)]
        texts = [b"".join(joined[x:y]) for x, y in zip(cuts[:-1], cuts[1:]) if x < y] + alone
        coded = lambda some: self.tokenizer.encode_batch_fast([text.decode("utf-8", "replace") for text in some], add_special_tokens=False)
        flat = lambda some: np.fromiter(itertools.chain.from_iterable(code.ids for code in coded(some)), np.uint32)
        ids = np.concatenate([np.zeros(0, np.uint32), *(flat(texts[i : i + AT_ONCE]) for i in range(0, len(texts), AT_ONCE))])
        reached = np.cumsum(self.bytes_of[ids])
        if len(ids) and reached[-1] != ends[-1]:  # bytes that are no UTF-8 were replaced
            each = [self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids for piece in [*joined, *alone]]
            return np.array([i for one in each for i in one], np.uint32), np.array([len(one) for one in each])
        return ids, np.diff(np.append(0, np.searchsorted(reached, ends, "right")))

    def learn(self, keys: np.ndarray, pieces: list[bytes], joins: np.ndarray) -> None:
        """Asks for the ids of new pieces, given in the order of their hashes, and remembers them."""
        order = np.argsort(~joins, kind="stable")
        n = int(joins.sum())
        ids, sizes = self.ids_of([pieces[i] for i in order[:n].tolist()], [pieces[i] for i in order[n:].tolist()])
        self.remember(keys, ids, sizes, order)

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many are of each."""
        letter = ((data | 32) >= 97) & ((data | 32) <= 122)
        # Also the first byte of a Latin-1 letter: all of that block are letters but for two signs.
        begins = letter.copy()
        begins[:-1] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)
        opens = np.zeros(len(data) + 1, bool)
        opens[:-2] = (data[:-1] == 32) & begins[1:]
        opens[1:-1] |= letter[:-1] & self.marks[data[1:]]
        opens[2:-1] |= _PRINTED[data[:-2]] & (data[1:-1] == 10) & begins[2:]
        # A space that ends its text has the next text's letter after it.
        last = bounds[1:-1] - 1
        last = last[last >= 0]
        opens[last[data[last] == 32]] = False
        opens[bounds[:-1]] = True
        starts = np.flatnonzero(opens[:-1])
        ends = np.append(starts[1:], len(data)) if len(starts) else starts
        # Spaces of different widths have different hashes: the length goes in as well.
        keys = w.mixed(w.hashes(data, starts, ends) + (ends - starts).astype(np.uint64))
        unique, seen, back = np.unique(keys, return_index=True, return_inverse=True)
        begin, _ = self.find(unique)
        new = np.flatnonzero(begin < 0)
        if len(new):
            if sum(len(known) for known, _, _ in self.known) + len(new) > MEMO_PIECES // 2:
                self.turn()
                new = np.arange(len(unique))
            new = new[~self.recall(unique[new])]
        if len(new):
            raw = data.tobytes()
            at = starts[seen[new]]
            joins = (data[at] == 32) & begins[np.minimum(at + 1, len(data) - 1)] & (ends[seen[new]] > at + 1)
            self.learn(unique[new], [raw[a:b] for a, b in zip(at.tolist(), ends[seen[new]].tolist())], joins)
        begin, size = (x[back] for x in self.find(unique))
        total = np.cumsum(size)
        if len(self.flat) > 1:
            self.flat = [np.concatenate(self.flat)]
        ids = self.flat[0][_ranges(begin, size)]
        edges = np.append(0, total)[np.searchsorted(starts, bounds)]
        return ids, np.diff(edges)


_encoders: dict[str, Encoder] = {}


def write_files(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encodes the texts and writes them to ``path`` in ascending doc_id order.

    The order is that of (part, piece, place in doc_ids). Rows are dealt to
    ranges of doc_id once, as texts; coding needs no further shuffle.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = _encoders.get(tokenizer) or _encoders.setdefault(tokenizer, Encoder(tokenizer))
        part, piece = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, end, data, bounds in w.chunks(batch.column(1), ROW_BYTES):
                ids, counts = encoder.encode(data, bounds)
                out = np.full(len(ids) + len(counts), end_id, np.uint32)
                closing = np.cumsum(counts + 1) - 1
                body = np.ones(len(out), bool)
                body[closing] = False
                out[body] = ids
                coded, block_at, escape_at, escape_high = pack(out)
                counts = (counts + 1).astype(np.uint32)
                yield pa.RecordBatch.from_pydict(
                    {
                        "part": pa.array([part], pa.int32()),
                        "piece": pa.array([piece], pa.int32()),
                        "doc_ids": pa.array([batch.column(0).slice(first, end - first).to_pylist()], pa.list_(pa.int64())),
                        "counts": pa.array([counts.tobytes()], pa.binary()),
                        "n": pa.array([len(out)], pa.int64()),
                        **{k: pa.array([v.astype(v.dtype.newbyteorder("<")).tobytes()], pa.binary()) for k, v in (("words", coded), ("block_at", block_at), ("escape_at", escape_at), ("escape_high", escape_high))},
                    }
                )
                piece += 1
        w.release()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), w.text_of(docs).alias("text"))
        .repartitionByRange(parts, "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    ordered.mapInArrow(run, FILE_SCHEMA).write.option("compression", "zstd").mode("overwrite").parquet(path)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files alone: doc_id, start, n_tokens, ids_crc32."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    # A row per file row without its ids: sums by part, then parts, then pieces of a part.
    sizes = files.select("part", "piece", "n")
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("piece")) - F.col("n")
    offsets = sizes.select("part", "piece", inside.alias("inside")).join(parts, "part").selectExpr("part", "piece", "inside + before AS begin")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                of = lambda name, kind: np.frombuffer(row[name], kind)  # noqa: E731, B023
                counts = of("counts", "<u4").astype(np.int64)
                ids = unpack(row["n"], of("words", "<u8"), of("block_at", "<u4"), of("escape_at", "<u4"), of("escape_high", "<u4"))
                ends = np.cumsum(counts)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist())]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(row["doc_ids"], pa.int64()),
                        "part": pa.array(np.full(len(counts), row["part"], np.int32)),
                        "piece": pa.array(np.full(len(counts), row["piece"], np.int32)),
                        "inside": pa.array(ends - counts),
                        "n_tokens": pa.array(counts),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    read = files.mapInArrow(run, "doc_id bigint, part int, piece int, inside bigint, n_tokens bigint, ids_crc32 bigint")
    return read.join(offsets, ["part", "piece"]).select("doc_id", F.expr("begin + inside").alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, path: str | None = None) -> DataFrame:
    """Writes the files and gives what reading them back yields."""
    path = path or shared_dir(docs.sparkSession, "token-files")
    write_files(docs, path, tokenizer, end_id)
    return read_files(docs.sparkSession, path)
