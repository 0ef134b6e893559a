"""Words of many texts at once: vectorised cutting and hashing on Arrow's byte buffers.

All word patterns used here are classes of UTF-8 bytes, so words are found on
bytes; a text is never cut, whatever its length.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts are taken together up to this size; a longer text stands alone
HASH_BYTES = 1 << 18  # words are hashed together up to this size

NON_SPACE = np.ones(256, bool)
NON_SPACE[[0x20, *range(0x09, 0x0E)]] = False  # [^\x20\x09-\x0D]
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_LETTERS = np.random.default_rng(20_231).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers["up"]) <= n:
        size = max(n, HASH_BYTES) + 1
        for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            _powers[name] = np.cumprod(row, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, bounds) of runs of rows; NULL is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if not len(texts):
        return
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    at = at.astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        end = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield first, end, data[at[first] : at[end]], at[first : end + 1] - at[first]
        first = end


def cut(data: np.ndarray, bounds: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the index of every text's first word."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = keep[data]
    here = inside[1:-1]
    first, last = here & ~inside[:-2], here & ~inside[2:]
    filled = bounds[:-1][bounds[:-1] < bounds[1:]]  # a word ends with its text
    first[filled] |= here[filled]
    ended = bounds[1:][bounds[:-1] < bounds[1:]] - 1
    last[ended] |= here[ended]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each byte range, by differences of running sums; ranges are in order and do not overlap.

    A hash does not depend on where its range lies, so runs of ranges are summed by themselves.
    """
    letters = _LETTERS[LOWER] if lower else _LETTERS
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        end = max(first + 1, int(np.searchsorted(ends, starts[first] + HASH_BYTES, "right")))
        begin = starts[first]
        some = data[begin : ends[end - 1]]
        up, down = _powers_to(len(some))
        total = np.zeros(len(some) + 1, np.uint64)
        np.cumsum(letters[some] * up[: len(some)], out=total[1:])
        from_, to = starts[first:end] - begin, ends[first:end] - begin
        out[first:end] = mixed((total[to] - total[from_]) * down[from_])
        first = end
    return out


def windows(word_hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the windows of ``size`` words that lie in one text, and their hashes."""
    n = len(word_hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    found = np.zeros(n, np.uint64)
    for step in range(size):
        found = found * _STEP + word_hashes[step : step + n]
    ends = np.repeat(first[1:], np.diff(first))
    at = np.flatnonzero(np.arange(n) + size <= ends[:n])
    return at, mixed(found[at])


def window_marks(word_hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """32 bits of the windows at some places, independent of the hashes that ``windows`` gives."""
    found = np.zeros(len(at), np.uint64)
    for step in range(size):
        found = found * _LETTERS[0] + mixed(word_hashes[at + step])
    return (mixed(found) >> np.uint64(32)).astype(np.uint32)


def covered(n: int, at: np.ndarray, size: int | np.ndarray) -> np.ndarray:
    """Which of ``n`` words a window that starts at one of the places covers."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, at, 1)
    np.add.at(change, at + size, -1)
    return np.cumsum(change[:-1]) > 0


def release() -> None:
    """Gives freed memory back to the system at a task's end: its worker stays for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim is not None:
        trim(0)


def text_of(docs, text: str = "text"):
    """The bytes of a text column do not depend on its Spark type."""
    return docs[text].cast("string")
