"""Removal of passages that repeat across documents, by level-wise doubling.

A window of ``min_words`` words is halved until it is short; windows of the
shortest length are looked up over the whole corpus, and only where two windows
that repeat make up one of twice the length (the last step overlaps them to reach
``min_words``) is the longer one looked up, until none is left to extend.

Texts are packed into blocks of a few MB, written once. At each level a block
sends every hash it has once, sorted and gap-coded, to the hash's bucket, and gets
back one bit per hash: rows of a frequent passage are merged within a block before
they are shuffled, and buckets are cut by hash, so none grows with a passage's
frequency. The last level compares hashes of 96 bits and smallest doc_ids.

A window is removed if its words also start in a document with a smaller doc_id.
NULL and empty texts have no words and come out empty. A NULL doc_id counts as
larger than all others. Rows that share a doc_id do not remove each other's words.
Texts shorter than a window stay. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import words as w
from codeloom.sources.tables import saved

BLOCK_BYTES = 4 << 20
BUCKET_WINDOWS = 250_000
SPARE_BITS = 7  # of a short window's key beyond the count of windows: 1 % of lone windows pass by chance
SHORTEST = 8
LAST = np.iinfo(np.int64).max
_GAP = 65535

ASK = "bucket bigint, block bigint, n int, keys binary, marks binary, docs binary"


def levels(min_words: int) -> list[int]:
    sizes = [min_words]
    while sizes[0] > SHORTEST:
        sizes.insert(0, -(-sizes[0] // 2))
    return sizes


def pack_gaps(sorted_keys: np.ndarray) -> bytes:
    """16 bits per gap; a larger one is written as steps of 65,535 and a rest."""
    gaps = np.diff(sorted_keys, prepend=np.uint64(0))
    steps = (gaps // np.uint64(_GAP)).astype(np.int64)
    out = np.full(int(steps.sum()) + len(gaps), _GAP, np.uint16)
    out[np.cumsum(steps + 1) - 1] = gaps % np.uint64(_GAP)
    return out.tobytes()


def unpack_gaps(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, np.uint16)
    return np.cumsum(steps, dtype=np.uint64)[steps != _GAP]


def _planes(values: np.ndarray) -> bytes:
    """64-bit numbers by byte plane, compressed: small numbers take few bytes."""
    return zstandard.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unplanes(raw: bytes, kind) -> np.ndarray:
    flat = np.frombuffer(zstandard.decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(8, -1).T).view(kind).ravel()


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, piece = TaskContext.get().partitionId(), 0
    for batch in batches:
        for first, end, data, bounds in w.chunks(batch.column(1), BLOCK_BYTES):
            yield pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([(part << 32) + piece], pa.int64()),
                    "ids": pa.array([batch.column(0).slice(first, end - first).to_pylist()], pa.list_(pa.int64())),
                    "bounds": pa.array([bounds.tobytes()], pa.binary()),
                    "n_windows": pa.array([int(np.count_nonzero(np.diff(w.NON_SPACE[data].view(np.int8), prepend=0) > 0))], pa.int64()),
                    "texts": pa.array([zstandard.compress(data.tobytes(), 3)], pa.binary()),
                }
            )
            piece += 1


class _Block:
    """Words of a block and its windows level by level."""

    def __init__(self, row: dict):
        self.data = np.frombuffer(zstandard.decompress(row["texts"]), np.uint8) if row["texts"] else np.zeros(0, np.uint8)
        self.bounds = np.frombuffer(row["bounds"], np.int64)
        self.ids = np.array([LAST if i is None else i for i in row["ids"]], np.int64)
        starts, ends, hashed = [], [], []
        self.first = np.zeros(len(self.bounds), np.int64)
        i, seen = 0, 0
        while i < len(self.bounds) - 1:
            j = max(i + 1, int(np.searchsorted(self.bounds, self.bounds[i] + w.CHUNK_BYTES, "right")) - 1)
            low = self.bounds[i]
            part = self.data[low : self.bounds[j]]
            s, e, first = w.cut(part, self.bounds[i : j + 1] - low, w.NON_SPACE)
            hashed.append(w.hashes(part, s, e))
            starts.append(s + low)
            ends.append(e + low)
            self.first[i : j + 1] = first + seen
            seen += len(s)
            i = j
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.starts, self.ends, self.hashed = join(starts, np.int64), join(ends, np.int64), join(hashed, np.uint64)
        self.doc = np.repeat(np.arange(len(self.ids)), np.diff(self.first))

    def windows(self, sizes: list[int], bits: int, replies: list) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows still alive at level ``len(replies)``."""
        alive = None
        for level, size in enumerate(sizes):
            at, hashed = w.windows(self.hashed, self.first, size)
            if alive is not None:
                both = alive[at] & alive[at + size - sizes[level - 1]]
                at, hashed = at[both], hashed[both]
            if level == len(replies):
                return at, hashed
            order, firsts, keys = self.grouped(hashed >> np.uint64(64 - bits))
            lasts = np.append(firsts[1:], len(order)) - 1
            own = self.doc[at[order[firsts]]] != self.doc[at[order[lasts]]] if len(order) else np.zeros(0, bool)
            group = np.repeat(np.arange(len(keys)), np.diff(np.append(firsts, len(order))))
            repeated = np.zeros(len(at), bool)
            repeated[order] = (own | _bits(replies[level], len(keys)))[group]
            alive = np.zeros(len(self.hashed) + 1, bool)
            alive[at[repeated]] = True
        raise AssertionError

    @staticmethod
    def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order by key (places rising), first of each key, and the keys."""
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        firsts = np.flatnonzero(np.append(True, found[1:] != found[:-1])) if len(found) else np.zeros(0, np.int64)
        return order, firsts, found[firsts]

    def smallest(self, at: np.ndarray, hashed: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """As grouped, by hash and mark, with the marks and the smallest doc_id of each group."""
        marks = w.window_marks(self.hashed, at, size)
        order, firsts = _both(hashed, marks)
        docs = self.ids[self.doc[at[order]]]
        heads = order[firsts]
        return order, firsts, hashed[heads], marks[heads], np.minimum.reduceat(docs, firsts) if len(firsts) else np.zeros(0, np.int64)


def _both(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by key and mark (places rising), and the first of each pair."""
    order = np.lexsort((marks, keys))
    found, seen = keys[order], marks[order]
    return order, np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (seen[1:] != seen[:-1]))) if len(order) else np.zeros(0, np.int64)


def _bits(reply: list | None, n: int) -> np.ndarray:
    out = [np.unpackbits(np.frombuffer(r["bits"], np.uint8), count=r["n"]).astype(bool) for r in sorted(reply or [], key=lambda r: r["bucket"])]
    out = np.concatenate(out) if out else np.zeros(0, bool)
    assert len(out) == n
    return out


def _pieces(keys: np.ndarray, shift: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of sorted keys by their high bits."""
    if len(keys):
        buckets = (keys >> np.uint64(shift)) if shift < 64 else np.zeros(len(keys), np.uint64)
        firsts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1]))
        yield from zip(buckets[firsts].tolist(), firsts.tolist(), [*firsts[1:].tolist(), len(keys)])


def _replies(table: pa.Table, decode, answer) -> pa.Table:
    """One bit for each key of each row of a bucket."""
    keys = [decode(x.as_py()) for x in table.column("keys")]
    sizes = [len(k) for k in keys]
    good = answer(np.concatenate(keys), table)
    cuts = np.split(good, np.cumsum(sizes)[:-1])
    return pa.table(
        {
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "n": pa.array(sizes, pa.int32()),
            "bits": pa.array([np.packbits(c).tobytes() for c in cuts], pa.binary()),
        }
    )


def _several(table: pa.Table) -> pa.Table:
    """Keys that more than one block has."""

    def answer(keys, _):
        order = np.argsort(keys, kind="stable")
        found = keys[order]
        same = found[1:] == found[:-1]
        out = np.zeros(len(keys), bool)
        out[order] = np.append(same, False) | np.append(False, same)
        return out

    return _replies(table, unpack_gaps, answer)


def _smaller(table: pa.Table) -> pa.Table:
    """Hashes that another block has in a document with a smaller doc_id."""

    def answer(keys, rows):
        docs = np.concatenate([_unplanes(x.as_py(), np.int64) for x in rows.column("docs")])
        marks = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in rows.column("marks")])
        order, firsts = _both(keys, marks)
        least = np.repeat(np.minimum.reduceat(docs[order], firsts), np.diff(np.append(firsts, len(order))))
        out = np.zeros(len(keys), bool)
        out[order] = least < docs[order]
        return out

    return _replies(table, lambda raw: _unplanes(raw, np.uint64), answer)


def without_repeats(docs: DataFrame, min_words: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by a space), spans (of words removed)."""
    sizes = levels(min_words)
    blocks = saved(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), w.text_of(docs).alias("text")).mapInArrow(
        _blocks, "block bigint, ids array<bigint>, bounds binary, n_windows bigint, texts binary"
    ), "blocks")
    total = blocks.agg(F.sum("n_windows")).first()[0] or 0
    bits = min(64, max(16, int(total).bit_length() + SPARE_BITS))
    bucket_bits = min(bits, max(0, (int(total) // BUCKET_WINDOWS).bit_length()))
    said: list[DataFrame] = []

    for level in range(len(sizes)):
        joined = _joined(blocks, said)
        last = level == len(sizes) - 1
        asks = joined.mapInArrow(_asker(sizes, bits, bucket_bits, level, last), ASK)
        replies = asks.groupBy("bucket").applyInArrow(_smaller if last else _several, "block bigint, bucket bigint, n int, bits binary")
        said.append(saved(replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "n", "bits")).alias(f"r{level}")), f"replies-{level}"))
    return _joined(blocks, said).mapInArrow(
        _finisher(sizes, bits), "doc_id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>"
    )


def _joined(blocks: DataFrame, said: list[DataFrame]) -> DataFrame:
    for reply in said:
        blocks = blocks.join(reply, "block", "left")
    return blocks


def _asker(sizes: list[int], bits: int, bucket_bits: int, level: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row)
                at, hashed = block.windows(sizes, bits, [row[f"r{k}"] for k in range(level)])
                if last:
                    _, _, keys, marks, docs = block.smallest(at, hashed, sizes[-1])
                    made = [(b, s, e, _planes(keys[s:e]), marks[s:e].tobytes(), _planes(docs[s:e])) for b, s, e in _pieces(keys, 64 - bucket_bits)]
                else:
                    keys = np.unique(hashed >> np.uint64(64 - bits))
                    rest = bits - bucket_bits
                    low = np.uint64((1 << rest) - 1)
                    made = [(b, s, e, pack_gaps(keys[s:e] & low), b"", b"") for b, s, e in _pieces(keys, rest)]
                if made:
                    yield pa.RecordBatch.from_pydict(
                        {
                            "bucket": pa.array([m[0] for m in made], pa.int64()),
                            "block": pa.array([row["block"]] * len(made), pa.int64()),
                            "n": pa.array([m[2] - m[1] for m in made], pa.int32()),
                            "keys": pa.array([m[3] for m in made], pa.binary()),
                            "marks": pa.array([m[4] for m in made], pa.binary()),
                            "docs": pa.array([m[5] for m in made], pa.binary()),
                        }
                    )

    return run


def _finisher(sizes: list[int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield _finished(row, _Block(row), sizes, bits)

    return run


def _finished(row: dict, block: _Block, sizes: list[int], bits: int) -> pa.RecordBatch:
    top = len(sizes) - 1
    at, hashed = block.windows(sizes, bits, [row[f"r{k}"] for k in range(top)])
    order, firsts, keys, _, least = block.smallest(at, hashed, sizes[-1])
    group = np.repeat(np.arange(len(keys)), np.diff(np.append(firsts, len(order))))
    gone = np.zeros(len(at), bool)
    gone[order] = _bits(row[f"r{top}"], len(keys))[group] | (block.ids[block.doc[at[order]]] > least[group])
    removed = w.covered(len(block.hashed), at[gone], sizes[-1])
    kept = ~removed
    # Bytes of kept words, and one space after each but a text's last.
    before = np.append(0, np.cumsum(kept))
    number = before[block.first]
    follows = kept & (before[1:] < np.repeat(number[1:], np.diff(block.first)))
    change = np.zeros(len(block.data) + 2, np.int8)
    np.add.at(change, block.starts[kept], 1)
    np.add.at(change, block.ends[kept] + follows[kept], -1)
    mask = np.cumsum(change[: len(block.data)], dtype=np.int8) > 0
    data = block.data.copy()
    data[block.ends[follows]] = 0x20
    sizes_out = np.append(0, np.cumsum(mask))[block.bounds]
    edge = np.diff(removed.view(np.int8), prepend=0, append=0)
    docs = block.doc
    opens = np.flatnonzero((edge[:-1] == 1) | (removed & np.append(True, docs[1:] != docs[:-1])[: len(removed)]))
    closes = np.flatnonzero((edge[1:] == -1) | (removed & np.append(docs[1:] != docs[:-1], True)[: len(removed)])) + 1
    base = np.repeat(block.first[:-1], np.diff(block.first))
    spans = pa.StructArray.from_arrays([pa.array(opens - base[opens]), pa.array(closes - base[opens])], ["start", "end"])
    at_span = np.searchsorted(opens, block.first).astype(np.int32)
    total = np.append(0, np.cumsum(removed))[block.first]
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": pa.array(row["ids"], pa.int64()),
            "n_words": pa.array(np.diff(block.first)),
            "n_removed": pa.array(np.diff(total)),
            "kept": pa.StringArray.from_buffers(len(row["ids"]), pa.py_buffer(sizes_out.astype(np.int32).tobytes()), pa.py_buffer(data[mask].tobytes())),
            "spans": pa.ListArray.from_arrays(pa.array(at_span), spans),
        }
    )
