"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of whole documents. Its words are numbered by the benchmark's
vocabulary; all other words are one separator, and stretches too short for any
phrase are left out of the index, as no phrase can occur there. The index is the
Burrows-Wheeler transform in a wavelet matrix. All phrases are searched backward
side by side; rows found are walked to the nearest sampled suffix position, and
the words they cover are merged into spans.

The benchmark goes to the executors in blocks of at most ``BLOCK_BYTES`` of text,
one after the other, so its size is bounded whatever its rows.

NULL and empty texts have no words: a document of none is clean, an item of none
occurs nowhere. Items may repeat; an item_id counts once, a NULL one as empty text.
Without items all documents are clean. Columns of the documents are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import words as w
from codeloom.llm.rows import fresh

WINDOW = 13
SHARD_BYTES = 4 << 20
BLOCK_BYTES = 16 << 20
SAMPLE = 16


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array of numbers whose last is smallest and unique, by doubling.

    Three numbers are sorted at once at first; later rounds sort only suffixes
    that still share their group.
    """
    n, wide = len(text), int(text.max()) + 1
    padded = np.concatenate([text, np.zeros(3, np.int64)])
    if wide < 1 << 20:
        key, reach = (padded[:n] * wide + padded[1 : n + 1]) * wide + padded[2 : n + 2], 3
    else:
        key, reach = padded[:n], 1
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    slots = np.arange(n)
    group = _group_starts(key[order], slots)
    rank[order] = group
    while True:
        again = _shared(group)
        if not again.any():
            return order
        slots = slots[again]
        members = order[slots]
        ahead = np.where(members + reach < n, rank[np.minimum(members + reach, n - 1)] + 1, 0)
        key = rank[members] * (n + 1) + ahead
        by = np.argsort(key, kind="stable")
        members = members[by]
        order[slots] = members
        group = _group_starts(key[by], slots)
        rank[members] = group
        reach *= 2


def _group_starts(sorted_keys: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """For each slot, the slot at which its run of equal keys begins."""
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    return slots[np.flatnonzero(new)][np.cumsum(new) - 1]


def _shared(group: np.ndarray) -> np.ndarray:
    same = group[1:] == group[:-1]
    return np.append(same, False) | np.append(False, same)


class FMIndex:
    """Counts and finds phrases in a text of numbers; the last number is 0 and unique."""

    def __init__(self, text: np.ndarray):
        order = suffix_order(text)
        last = text[order - 1]
        self.symbols = int(text.max()) + 1
        self.begin = np.searchsorted(np.sort(text), np.arange(self.symbols + 1))
        self.levels = max(1, (self.symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        rest = last
        for level in range(self.levels - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(bool)
            self.ones.append(np.append(0, np.cumsum(bit)).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            rest = np.concatenate([rest[~bit], rest[bit]])
        self.base = self._down(np.arange(self.symbols), np.zeros(self.symbols, np.int64))
        self.marked = order % SAMPLE == 0
        self.mark_rank = np.append(0, np.cumsum(self.marked)).astype(np.int32)
        self.samples = order[self.marked]

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for depth, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.ones[depth][at]
            at = np.where((symbol >> level) & 1, self.zeros[depth] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place in the transform."""
        return self._down(symbol, at) - self.base[symbol]

    def back(self, at: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one number longer."""
        symbol, here = np.zeros(len(at), np.int64), at
        for depth in range(self.levels):
            ones = self.ones[depth][here]
            bit = self.ones[depth][here + 1] - ones
            symbol = symbol * 2 + bit
            here = np.where(bit, self.zeros[depth] + ones, here - ones)
        return self.begin[symbol] + here - self.base[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases (a row each, padded at the end)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.begin[-1], np.int64)
        live = np.arange(len(phrases))
        for step in range(int(sizes.max()) if len(sizes) else 0):
            live = live[(sizes[live] > step) & (low[live] < high[live])]
            symbol = phrases[live, sizes[live] - 1 - step]
            low[live] = self.begin[symbol] + self.rank(symbol, low[live])
            high[live] = self.begin[symbol] + self.rank(symbol, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, walked = np.zeros(len(rows), np.int64), 0
        open_, here = np.arange(len(rows)), rows
        while len(open_):
            done = self.marked[here]
            at[open_[done]] = self.samples[self.mark_rank[here[done]]] + walked
            open_, here = open_[~done], self.back(here[~done])
            walked += 1
        return at


class Phrases:
    """Windows of a block of items by word number, and the items that have them."""

    def __init__(self, items: list[tuple[str, str | None]], window: int = WINDOW):
        texts = pa.array([text for _, text in items], pa.string())
        hashed, first = [], [0]
        for _, _, data, bounds in w.chunks(texts):
            starts, ends, begins = w.cut(data, bounds, w.ALNUM)
            hashed.append(w.hashes(data, starts, ends, lower=True))
            first.extend((begins[1:] + first[-1]).tolist())
        hashed = np.concatenate(hashed) if hashed else np.zeros(0, np.uint64)
        self.vocabulary, number = np.unique(hashed, return_inverse=True)
        windows: dict[tuple[int, ...], set[str]] = {}
        for (item, _), a, b in zip(items, first[:-1], first[1:]):
            row = number[a:b].tolist()
            for at in range(max(1, len(row) - window + 1) if row else 0):
                windows.setdefault(tuple(row[at : at + window]), set()).add(item)
        self.items = [tuple(sorted(x)) for x in windows.values()]
        self.sizes = np.array([len(x) for x in windows], np.int64)
        self.numbers = np.zeros((len(windows), window), np.int64)
        for i, x in enumerate(windows):
            self.numbers[i, : len(x)] = x

    def occurrences(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word of each text, place (word) of each hit and its phrase."""
        starts, ends, first = w.cut(data, bounds, w.ALNUM)
        none = first, np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not len(self.sizes) or not len(starts):
            return none
        hashed = w.hashes(data, starts, ends, lower=True)
        number = np.minimum(np.searchsorted(self.vocabulary, hashed), len(self.vocabulary) - 1)
        known = self.vocabulary[number] == hashed
        # Stretches of known words within a text, long enough for the shortest phrase.
        owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
        breaks = np.append(True, ~known[1:] | ~known[:-1] | (owner[1:] != owner[:-1]))
        stretch = np.cumsum(breaks) - 1
        long = known & (np.bincount(stretch)[stretch] >= self.sizes.min())
        at = np.flatnonzero(long)
        if not len(at):
            return none
        # 0 ends the text, 1 separates, words follow in the order of those present.
        gaps = np.append(0, np.cumsum(stretch[at[1:]] != stretch[at[:-1]]))
        place = np.arange(len(at)) + gaps
        present, local = np.unique(number[at], return_inverse=True)
        text = np.ones(len(at) + gaps[-1] + 2, np.int64)
        text[-1] = 0
        text[place] = local + 2
        word_at = np.zeros(len(text), np.int64)
        word_at[place] = at
        table = np.full(len(self.vocabulary), -1, np.int64)
        table[present] = np.arange(len(present)) + 2
        phrases = table[self.numbers]
        missing = (phrases < 0) & (np.arange(phrases.shape[1]) < self.sizes[:, None])
        able = np.flatnonzero(~missing.any(axis=1))
        if not len(able):
            return none
        index = FMIndex(text)
        low, high = index.search(phrases[able], self.sizes[able])
        count = high - low
        rows = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return first, word_at[index.locate(rows)], np.repeat(able, count)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def _shard(phrases: Phrases, texts: pa.Array, held: list | None) -> Iterator[tuple[int, list, list]]:
    """(n_words, spans, items) of each text, with what earlier blocks found."""
    row = 0
    for begin, end, data, bounds in w.chunks(texts, SHARD_BYTES):
        first, at, phrase = phrases.occurrences(data, bounds)
        owner = np.searchsorted(first, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        at, phrase = at[order], phrase[order]
        edges = np.searchsorted(owner[order], np.arange(end - begin + 1))
        for i in range(end - begin):
            a, b = edges[i], edges[i + 1]
            spans, items = held[row] if held else ([], [])
            if a < b:
                places = at[a:b] - first[i]
                spans = _merged([*spans, *zip(places.tolist(), (places + phrases.sizes[phrase[a:b]]).tolist())])
                items = sorted({*items, *(x for p in set(phrase[a:b].tolist()) for x in phrases.items[p])})
            yield int(first[i + 1] - first[i]), spans, items
            row += 1


def _blocks_of(benchmark: DataFrame) -> Iterator[list[tuple[str, str | None]]]:
    """The items in blocks of bounded size, read one partition at a time."""
    block: list[tuple[str, str | None]] = []
    size = 0
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("string"))
    for item, text in rows.toLocalIterator():
        if block and size + len(text or "") > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((item, text))
        size += len(text or "")
    yield block


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """The rows with n_words, spans (of words, merged) and items (sorted ids); and the new names."""
    names = [fresh(docs, name) for name in ("n_words", "spans", "items")]
    pairs = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    added = [T.StructField(names[0], T.LongType()), T.StructField(names[1], pairs), T.StructField(names[2], T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *added])
    place, width = docs.columns.index(text), len(docs.columns)
    arrow = to_arrow_schema(schema)
    out = docs
    for turn, block in enumerate(_blocks_of(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(Phrases(block, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                held = None
                if turn:
                    held = [([(s["start"], s["end"]) for s in a], b) for a, b in zip(batch.column(width + 1).to_pylist(), batch.column(width + 2).to_pylist())]
                found = list(_shard(shared.value, batch.column(place).cast(pa.string()), held))
                columns = [
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([[{"start": a, "end": b} for a, b in f[1]] for f in found], arrow.field(names[1]).type),
                    pa.array([f[2] for f in found], arrow.field(names[2]).type),
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], *columns], names=schema.names)
            w.release()

        out = out.mapInArrow(run, schema)
    return out, names


def contaminated(n_words, spans):
    """At least one word in twenty, and one at all, lies in a benchmark window."""
    hit = hit_words(spans)
    return (hit > 0) & (20 * hit >= n_words)


def hit_words(spans):
    return F.aggregate(spans, F.lit(0).cast("bigint"), lambda total, s: total + s["end"] - s["start"])


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated; columns as they come."""
    found, (n_words, spans, _) = contamination(docs, benchmark)
    return found.filter(~contaminated(F.col(n_words), F.col(spans))).select(*docs.columns)
