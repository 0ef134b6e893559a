"""Secrets in text: fixed patterns, and a character network over wider candidates.

The patterns give the base findings, which always stay. Candidates are these and every
run of 16 or more characters of the alphabet of keys that has a letter and a
digit. A convolutional network in numpy reads each candidate, whole, with the text around
it and gives a probability; candidates that reach beyond each base finding are added
beside them where it reaches the threshold, the largest that keeps the wanted recall on
labelled findings held back from fitting.

It is fitted on labelled findings: (text, start, end, label) in code points. Those made
by ``own_findings`` are candidates of the corpus, labelled 1 where a base pattern
matches, in the texts of at most ``MOST`` documents, and 0 for long words and for runs whose
pieces are each a word or a number, like ids, paths and versions. As a corpus may have few
of these, some are also put together from its long words. NULL texts are empty. Columns
are passed through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import rows, words as w
from codeloom.sources.tables import saved

KINDS = ("assign", "access", "hex", "network")
#: Fixed patterns of the base findings, and the fewest characters of what counts.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST = {"assign": 12, "access": 18, "hex": 16}
KEYWORDS = (b"passw", b"secret", b"token", b"apikey", b"api_key")
WIDE = 16
MOST = 20_000
AROUND = 24  # bytes read before and after a candidate's ends
LENGTH = 2 * AROUND + 32
FILTERS, REACH = 16, 5
RECALL = 0.98

_HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_KEY = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", np.uint8))
_DIGIT = np.isin(np.arange(256), np.arange(0x30, 0x3A))
_LETTER = np.isin(np.arange(256) | 32, np.arange(0x61, 0x7B)) & (np.arange(256) < 128)
#: Character number: itself for ASCII, one for all others, 0 beyond the text.
_NUMBER = np.where(np.arange(256) < 128, np.arange(256), 128).astype(np.uint8)
_NUMBER[0] = 128
SYMBOLS = 129


def base_findings(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(text, start, end, kind) in bytes from the buffer's begin, of all texts."""
    found = []
    starts, ends, first = w.cut(data, bounds, _HEX)
    long = np.flatnonzero(ends - starts >= LEAST["hex"])
    owner = np.searchsorted(bounds, starts[long], "right") - 1
    found += [(o, a, b, 2) for o, a, b in zip(owner.tolist(), starts[long].tolist(), ends[long].tolist())]
    raw = data.tobytes()
    lowered = w.LOWER[data].tobytes()
    for kind, keys, where in ((0, KEYWORDS, lowered), (1, (b"AKIA",), raw)):
        places = [m.start() for key in keys for m in re.finditer(re.escape(key), where)]
        for o in np.unique(np.searchsorted(bounds, np.array(places, np.int64), "right") - 1).tolist():
            text = raw[bounds[o] : bounds[o + 1]]
            for m in (ASSIGN, ACCESS)[kind].finditer(text):
                counted = m.group(2) if kind == 0 else m.group()
                if len(counted) >= LEAST[KINDS[kind]]:
                    found.append((o, int(bounds[o]) + m.start(), int(bounds[o]) + m.end(), kind))
    return sorted(found, key=lambda x: (x[0], x[1], x[3]))


def wide_candidates(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of long runs of key characters with a letter and a digit."""
    starts, ends, _ = w.cut(data, bounds, _KEY)
    long = np.flatnonzero(ends - starts >= WIDE)
    starts, ends = starts[long], ends[long]
    digits, letters = np.append(0, np.cumsum(_DIGIT[data])), np.append(0, np.cumsum(_LETTER[data]))
    mixed = (digits[ends] > digits[starts]) & (letters[ends] > letters[starts])
    owner = np.searchsorted(bounds, starts[mixed], "right") - 1
    return list(zip(owner.tolist(), starts[mixed].tolist(), ends[mixed].tolist()))


def long_words(data: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the other long runs: what plain text has in place of secrets."""
    starts, ends, _ = w.cut(data, bounds, _KEY)
    long = np.flatnonzero(ends - starts >= WIDE - 4)
    owner = np.searchsorted(bounds, starts[long], "right") - 1
    return list(zip(owner.tolist(), starts[long].tolist(), ends[long].tolist()))


def plain_runs(data: np.ndarray, runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the runs in which no letter stands beside a digit."""
    digit, letter = _DIGIT[data], _LETTER[data]
    beside = np.append(0, np.cumsum((digit[1:] & letter[:-1]) | (letter[1:] & digit[:-1])))
    return [(o, a, b) for o, a, b in runs if beside[b - 1] == beside[a]]


def made_run(word: bytes) -> bytes:
    """An id, path or version of the word's halves and a number, all set by the word."""
    n, half = crc32(word), len(word) // 2
    number, mark = str(n >> 8)[: 2 + n % 6], "_-/"[n % 3]
    parts = [word[:half].decode("ascii"), word[half:].decode("ascii"), number]
    return mark.join(parts if n & 64 else parts[::-1]).encode()


def beyond(runs: list[tuple[int, int, int]], base: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of the runs that lie in no single base finding."""
    if not base or not runs:
        return runs
    spans = np.array(sorted((a, b) for _, a, b, _ in base))
    reach = np.append(-1, np.maximum.accumulate(spans[:, 1]))
    last = reach[np.searchsorted(spans[:, 0], [a for _, a, _ in runs], "right")]
    return [run for run, end in zip(runs, last.tolist()) if end < run[2]]


def view(data: np.ndarray, low: int, high: int, start: int, end: int) -> np.ndarray:
    """Characters of the candidate with what stands around, as numbers; 0 beyond the text.

    A row is a window; those of a longer candidate overlap so far that every place of the convolution is in one.
    """
    inner, before, after = data[start:end], data[max(low, start - AROUND) : start], data[end : min(high, end + AROUND)]
    out = np.zeros(max(LENGTH, 2 * AROUND + len(inner)), np.uint8)
    out[AROUND - len(before) : AROUND] = _NUMBER[before]
    out[AROUND : AROUND + len(inner)] = _NUMBER[inner]
    out[AROUND + len(inner) : AROUND + len(inner) + len(after)] = _NUMBER[after]
    starts = np.append(np.arange(0, len(out) - LENGTH, LENGTH - REACH + 1), len(out) - LENGTH)
    return out[starts[:, None] + np.arange(LENGTH)]


@dataclass
class Network:
    """One convolution over characters, the largest value of each filter, and a logistic unit."""

    kernel: np.ndarray  # REACH x SYMBOLS x FILTERS
    offset: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 0.5

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest value of each filter in each window, and its place."""
        n_places = windows.shape[1] - REACH + 1
        out = np.repeat(self.offset[None, None, :], len(windows), 0).repeat(n_places, 1)
        for step in range(REACH):
            out += self.kernel[step][windows[:, step : step + n_places]]
        return out.max(axis=1), out.argmax(axis=1)

    def output(self, views: list[np.ndarray]) -> np.ndarray:
        if not views:
            return np.zeros(0)
        windows = np.concatenate(views)
        top = np.concatenate([self.pooled(windows[i : i + 1024])[0] for i in range(0, len(windows), 1024)])
        return np.maximum(np.maximum.reduceat(top, _heads(views)), 0) @ self.weight + self.bias

    def probability(self, views: list[np.ndarray]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.output(views) + self.shift, -30, 30)))


def _heads(views: list[np.ndarray]) -> np.ndarray:
    """Number of each candidate's first window."""
    return np.append(0, np.cumsum([len(v) for v in views])[:-1])


def train(views: list[np.ndarray], labels: np.ndarray, rounds: int = 8, pace: float = 0.02) -> Network | None:
    """A calibrated network with its threshold; None without findings of both labels.

    One finding in four is held back for the calibration and the threshold.
    """
    held = np.arange(len(labels)) % 4 == 3
    if min(labels[~held].sum(), (1 - labels[~held]).sum(), labels[held].sum(), (1 - labels[held]).sum()) < 1:
        return None
    random = np.random.default_rng(12)
    net = Network(random.normal(0, 0.1, (REACH, SYMBOLS, FILTERS)), np.zeros(FILTERS), random.normal(0, 0.3, FILTERS), 0.0)
    x, y = [v for v, h in zip(views, held) if not h], labels[~held].astype(float)
    mine = [v for v, h in zip(views, held) if h]
    balance = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for turn in range(rounds):
        step = pace / (1 + turn / 2)
        for some in np.array_split(random.permutation(len(y)), max(1, len(y) // 64)):
            batch = [x[i] for i in some]
            windows, heads = np.concatenate(batch), _heads(batch)
            most, place = net.pooled(windows)
            top = np.maximum.reduceat(most, heads)
            equal = most == np.repeat(top, [len(v) for v in batch], axis=0)
            window = np.minimum.reduceat(np.where(equal, np.arange(len(windows))[:, None], len(windows)), heads)
            place, top = np.take_along_axis(place, window, axis=0), np.maximum(top, 0)
            p = 1 / (1 + np.exp(-np.clip(top @ net.weight + net.bias, -30, 30)))
            slope = (p - y[some]) * balance[some]
            back = slope[:, None] * net.weight[None, :] * (top > 0)
            net.weight -= step * slope @ top / len(some) * 4
            net.bias -= step * slope.mean() * 4
            net.offset -= step * back.sum(axis=0) / len(some) * 4
            for reach in range(REACH):
                symbols = windows[window, place + reach]
                np.add.at(net.kernel[reach], (symbols, np.arange(FILTERS)[None, :]), -step * back / 4)
    out, label = net.output(mine), labels[held].astype(float)
    curve = np.array([1.0, 0.0])
    for _ in range(50):
        a = np.stack([out, np.ones(len(out))], axis=1)
        p = 1 / (1 + np.exp(-np.clip(a @ curve, -30, 30)))
        hessian = (a * (p * (1 - p))[:, None]).T @ a + 1e-2 * np.eye(2)
        curve -= np.clip(np.linalg.solve(hessian, a.T @ (p - label) + 1e-2 * curve), -2, 2)
    net.slope, net.shift = float(curve[0]), float(curve[1])
    good = np.sort(net.probability(mine)[label == 1])
    net.threshold = float(good[int((1 - RECALL) * len(good))])
    return net


def _labelled_views(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, bounds in w.chunks(batch.column(1)):
            base = base_findings(data, bounds)
            taken = np.zeros(len(data) + 1, bool)
            for _, a, b, _ in base:
                taken[a:b] = True
            found = [(o, a, b, 1) for o, a, b, _ in base]
            values = [(o, a + ASSIGN.match(data[a:b].tobytes()).start(2), b, 1) for o, a, b, kind in base if kind == 0]
            words = [(o, a, b) for o, a, b in plain_runs(data, long_words(data, bounds)) if not taken[a:b].any()]
            found += [(o, a, b, 0) for o, a, b in words]
            if found:
                views = [view(data, bounds[o], bounds[o + 1], a, b) for o, a, b, _ in found]
                # Once more without what stands around, so that a key is known by itself too.
                found += [*found, *values]
                views += [view(data, a, b, a, b) for _, a, b, _ in found[len(views) :]]
                for o, a, b in words:
                    if not _DIGIT[data[a:b]].any():
                        made = np.frombuffer(made_run(data[a:b].tobytes()), np.uint8)
                        low, high = max(bounds[o], a - AROUND), min(bounds[o + 1], b + AROUND)
                        around = np.concatenate([data[low:a], made, data[b:high]])
                        views.append(view(around, 0, len(around), a - low, a - low + len(made)))
                        found.append((o, a, b, 0))
                yield pa.RecordBatch.from_pydict({"label": pa.array([f[3] for f in found], pa.int32()), "view": pa.array([v.tobytes() for v in views], pa.binary())})
    w.release()


def own_findings(docs: DataFrame, most: int = MOST) -> tuple[list[np.ndarray], np.ndarray]:
    """Views and labels of findings in the ``most`` documents of least hash of their id."""
    ids = docs.filter("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id", F.lit(9)), "doc_id").limit(most).distinct()
    texts = docs.select("doc_id", w.text_of(docs).alias("text")).join(F.broadcast(ids), "doc_id")
    found = saved(texts.mapInArrow(_labelled_views, "label int, view binary").distinct(), "labelled-views")
    # At most ``most`` views of either label, those of least digest.
    parts = [found.filter(F.col("label") == k).orderBy(F.md5("view"), "view").limit(most // 4).collect() for k in (1, 0)]
    got = sorted((r for part in parts for r in part), key=lambda r: bytes(r["view"])[::-1])
    views = [np.frombuffer(r["view"], np.uint8).reshape(-1, LENGTH) for r in got]
    return views, np.array([r["label"] for r in got], np.int64)


def scan(docs: DataFrame, network: Network | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with findings: kind, start, end (code points) and the network's score, by start, then kind."""
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def compute(texts: pa.Array):
        net, out = shared.value, []
        for begin, end, data, bounds in w.chunks(texts.cast(pa.string())):
            base = base_findings(data, bounds)
            found = [*base, *((o, a, b, 3) for o, a, b in beyond(wide_candidates(data, bounds), base) if net)]
            score: list = [None] * len(found)
            if net and found:
                views = [view(data, bounds[o], bounds[o + 1], a, b) for o, a, b, _ in found]
                score = net.probability(views).tolist()
            mine: list[list] = [[] for _ in range(end - begin)]
            points: dict[int, np.ndarray] = {}
            for (o, a, b, kind), s in zip(found, score):
                if kind == 3 and s < net.threshold:
                    continue
                if o not in points:
                    points[o] = np.append(0, np.cumsum((data[bounds[o] : bounds[o + 1]] & 0xC0) != 0x80))
                mine[o].append((int(points[o][a - bounds[o]]), kind, int(points[o][b - bounds[o]]), s))
            for rows_ in mine:
                out.append([{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in sorted(rows_, key=lambda x: x[:2])])
        return [out]

    return rows.with_columns(docs, "findings array<struct<kind:string,start:bigint,end:bigint,score:double>>", compute, text)
