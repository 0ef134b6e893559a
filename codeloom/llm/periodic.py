"""Runs in texts: stretches of words that repeat with a period at least twice.

A suffix automaton reads the words. Its suffix links form a tree, held as a link-cut
tree in which a preferred path holds the states of one last occurrence. Appending a
word accesses the path from the new state to the root: each segment met was
last seen at a previous end, and now ends here. If the distance of the two ends is no more than
the length of the segment's longest string, these occurrences touch or overlap: a square, whose left
end is as far left as it goes. The ends of one left end and distance, taken together, extend
it to a run, and the distance is its smallest period.

Words that cannot lie in a run of ``min_length`` words never reach the automaton: in such a
run each word is covered by a window of half that many words which occurs twice
in the run. Windows are compared by 64-bit hashes, so a false match only adds work; the
automaton compares the words.

NULL and empty texts have no runs and collapse to an empty text. Each row is judged
by itself: repeated rows and NULL ids make no difference. A very long text is one
row; the automaton takes time n log n and some hundred bytes a word in its repetitive parts only.
An empty table gives an empty one; new columns whose name is taken get underscores in front.
"""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeloom.llm import rows
from codeloom.llm import words as w

MIN_LENGTH = 12


class _Automaton:
    """Suffix automaton of a word sequence with last occurrences in a link-cut tree; state 1 is the root, 0 none."""

    def __init__(self, size: int):
        # Most states have one way on: a letter and a state. The others' further ways are in ``more``.
        self.letter, self.to, self.more = array("i", [-1, -1]), array("i", [0, 0]), {}
        self.link, self.length = array("i", [0, 0]), array("i", [0, 0])
        self.up, self.left, self.right = array("i", [0, 0]), array("i", [0, 0]), array("i", [0, 0])
        self.seen = array("i", [-1, -1])  # of a path's splay root: where the states of the path occurred last
        self.last = 1

    def _state(self, length: int) -> int:
        self.letter.append(-1)
        self.to.append(0)
        self.length.append(length)
        for row in (self.link, self.up, self.left, self.right):
            row.append(0)
        self.seen.append(-1)
        return len(self.length) - 1

    def _append(self, word: int) -> int:
        letter, to, more, link, length = self.letter, self.to, self.more, self.link, self.length
        new, at = self._state(length[self.last] + 1), self.last
        self.last = new
        while at:
            if letter[at] == word:
                target = to[at]
                break
            if letter[at] < 0:
                letter[at], to[at] = word, new
            else:
                ways = more.setdefault(at, {})
                if word in ways:
                    target = ways[word]
                    break
                ways[word] = new
            at = link[at]
        else:
            target = 1
        if at and length[at] + 1 < length[target]:
            target = self._split(at, word, target)
        link[new] = self.up[new] = target
        return new

    def _split(self, at: int, word: int, old: int) -> int:
        """The shorter strings of ``old`` get a state of their own, next to it on its path."""
        letter, to, more, link = self.letter, self.to, self.more, self.link
        new = self._state(self.length[at] + 1)
        letter[new], to[new], link[new] = letter[old], to[old], link[old]
        if old in more:
            more[new] = dict(more[old])
        self._splay(old)
        above = self.left[old]
        if above:
            self.up[above] = new
        self.left[new], self.left[old], self.up[new] = above, new, old
        link[old] = new
        while at:
            if letter[at] == word:
                if to[at] != old:
                    break
                to[at] = new
            else:
                ways = more.get(at)
                if not ways or ways.get(word) != old:
                    break
                ways[word] = new
            at = link[at]
        return new

    def _splay(self, x: int) -> None:
        up, left, right, seen = self.up, self.left, self.right, self.seen
        while True:
            y = up[x]
            if not y or (left[y] != x and right[y] != x):
                return
            z = up[y]
            if z and (left[z] == y or right[z] == y):
                seen[x] = seen[z]
                first = y if (left[z] == y) == (left[y] == x) else x
                for node in (first, x):
                    self._rotate(node, up, left, right)
            else:
                seen[x] = seen[y]
                self._rotate(x, up, left, right)

    @staticmethod
    def _rotate(x: int, up: array, left: array, right: array) -> None:
        y = up[x]
        z = up[y]
        if left[y] == x:
            inner = right[x]
            left[y], right[x] = inner, y
        else:
            inner = left[x]
            right[y], left[x] = inner, y
        if inner:
            up[inner] = y
        up[y], up[x] = x, z
        if z:
            if left[z] == y:
                left[z] = x
            elif right[z] == y:
                right[z] = x

    def squares(self, sequence: list[int]) -> dict[tuple[int, int], int]:
        """(left end, period) of the squares, with the last place at which each ends."""
        found: dict[tuple[int, int], int] = {}
        up, right, seen, length = self.up, self.right, self.seen, self.length
        for end, word in enumerate(sequence):
            below = self._append(word)
            x = up[below]
            while x:
                self._splay(x)
                before = seen[x]
                distance, long = end - before, length[x]
                if distance <= long:
                    found[end - long - distance + 1, distance] = end
                cut = right[x]
                if cut:
                    seen[cut] = before
                right[x] = below
                below, x = x, up[x]
            seen[below] = end
        return found


def runs_of(sequence: list[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of at least ``min_length`` items, by start, then period."""
    squares = _Automaton(len(sequence)).squares(sequence)
    return sorted((start, end - start + 1, period) for (start, period), end in squares.items() if end - start + 1 >= min_length)


def _stretches(hashed: np.ndarray, first: np.ndarray, min_length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words in which runs can lie; each is in one text."""
    size = (min_length + 1) // 2
    n = len(hashed)
    at, keys = w.windows(hashed, first, size)
    part = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = -1
    while len(at) and len(at) != left:
        left = len(at)
        found = w.mixed(keys + part[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(found, kind="stable")
        same = found[order[1:]] == found[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = w.covered(n, at[twice], size)
        opens = covered & np.append(True, ~covered[:-1] | (part[1:] != part[:-1]))
        part = np.cumsum(opens)  # words between two stretches bear the number of the one before
        lengths = np.bincount(part[covered], minlength=part[-1] + 1 if n else 1)
        covered &= lengths[part] >= min_length
        inside = np.append(0, np.cumsum(covered))
        keep = twice & (inside[at + size] - inside[at] == size) & (part[at] == part[at + size - 1])
        at, keys = at[keep], keys[keep]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = covered & np.append(True, ~covered[:-1] | (part[1:] != part[:-1]))
    shut = covered & np.append(~covered[1:] | (part[1:] != part[:-1]), True)
    return np.flatnonzero(edge), np.flatnonzero(shut) + 1


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The kept words of each text, one space between two."""
    number = np.append(0, np.cumsum(kept))[first]  # kept words before each text
    starts, ends = starts[kept], ends[kept]
    sizes = ends - starts + 1  # with a space
    sizes[number[1:][number[1:] > number[:-1]] - 1] -= 1
    bounds = np.append(0, np.cumsum(sizes))
    change = np.zeros(int(bounds[-1]) + 1, np.int64)
    change[bounds[:-1]] = starts - np.append(0, (starts + sizes)[:-1])
    change[0] = starts[0] if len(starts) else 0
    # A byte's place is the one before it plus one, but at a word's start.
    place = np.cumsum(change[:-1] + 1) - 1
    out = data[np.minimum(place, len(data) - 1)] if len(place) else np.zeros(0, np.uint8)
    spaced = (bounds[1:] - 1)[sizes > ends - starts]
    out[spaced] = 0x20
    return pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(bounds[number].astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _judged(data: np.ndarray, bounds: np.ndarray, min_length: int) -> tuple[pa.Array, pa.Array]:
    """Runs, and the text without what repeats, of texts that lie behind each other."""
    starts, ends, first = w.cut(data, bounds, w.NON_SPACE)
    n = len(starts)
    found: list[tuple[int, int, int]] = []
    if n:
        raw = data.tobytes()
        for s, e in zip(*_stretches(w.hashes(data, starts, ends), first, min_length)):
            numbers: dict[bytes, int] = {}
            sequence = [numbers.setdefault(raw[a:b], len(numbers)) for a, b in zip(starts[s:e].tolist(), ends[s:e].tolist())]
            found += [(int(s) + start, length, period) for start, length, period in runs_of(sequence, min_length)]
    table = np.array(found, np.int64).reshape(-1, 3)
    dropped = np.zeros(n + 1, np.int64)
    np.add.at(dropped, table[:, 0] + table[:, 2], 1)
    np.add.at(dropped, table[:, 0] + table[:, 1], -1)
    doc = np.searchsorted(first, table[:, 0], "right") - 1
    fields = [pa.array(table[:, 0] - first[doc]), pa.array(table[:, 1]), pa.array(table[:, 2])]
    spans = pa.StructArray.from_arrays(fields, ["start", "length", "period"])
    runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(len(bounds))).astype(np.int32)), spans)
    return runs, _joined(data, starts, ends, first, np.cumsum(dropped[:-1]) == 0)


def with_runs(docs: DataFrame, min_length: int = MIN_LENGTH, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with runs (start, length, period; by start, then period) and collapsed; and the names of these columns.

    ``collapsed`` holds the words, joined by one space, that no run contains after its
    first period.
    """

    def compute(texts: pa.Array) -> list:
        made = [_judged(data, bounds, min_length) for _, _, data, bounds in w.chunks(texts)]
        return [pa.chunked_array([m[i] for m in made], [RUNS, pa.string()][i]).combine_chunks() for i in range(2)]

    return rows.with_columns(docs, "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string", compute, text)


RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
