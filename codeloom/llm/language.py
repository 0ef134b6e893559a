"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from its code point. A three-letter run is bound as the
product of the first letter's vector permuted twice, the second's permuted once and
the third's; a text's vector bundles (sums) its runs. A language's prototype
bundles its training texts, and a text has the language whose prototype is nearest
by cosine. Letters of all scripts and their combining marks count, in lower case; all between them counts as one blank.

A task bundles its training texts to one vector of whole numbers for each language, and these are added up by an
aggregate, so that prototypes do not depend on how rows are dealt. Any number of languages is learned: they are
compared in blocks of at most ``LANGUAGES``, of which one is broadcast (2 KB a language); more blocks take one pass
over the texts each.

NULL texts, empty texts and others without a letter are ``und`` with score 0, and so are all texts if no
training row has a language. Ties go to the first language by code point. Very long texts are read whole. An empty
table gives no row. Columns are passed through; repeated rows are judged alike.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm import rows, words as w
from codeloom.sources.tables import saved

DIMENSIONS = 512
LANGUAGES = 16_384
TOGETHER = 256  # texts whose runs are counted in one table
RUNS = 16_384  # different runs bound at a time
_POINTS = 0x110000


@cache
def _alphabet() -> np.ndarray:
    """For each code point the letter it counts as: positive for letters, negative for marks, 0 for others."""
    table = np.zeros(_POINTS, np.int32)
    for point in range(_POINTS):
        char = chr(point)
        if char.isalpha():
            small = char.lower()
            table[point] = ord(small) if len(small) == 1 else point
        elif point >= 0x300 and unicodedata.category(char)[0] == "M":
            table[point] = -point
    return table


def letter_vectors(letters: np.ndarray) -> np.ndarray:
    """A vector of +1 and -1 for each code point."""
    seeds = letters.astype(np.uint64)[:, None] * np.uint64(DIMENSIONS // 64) + np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = np.unpackbits(w.mixed(seeds + np.uint64(1_618_033_988)).view(np.uint8), axis=1)
    return bits.astype(np.float32) * 2 - 1


def _points(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts, and the bounds of each text in them."""
    if not len(data) or data.max() < 0x80:
        return data, bounds
    decoded = lambda some: np.frombuffer(some.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    points, at = decoded(data), np.append(0, np.cumsum((data & 0xC0) != 0x80))[bounds]
    if len(points) != at[-1]:  # bytes that are no UTF-8
        parts = [decoded(data[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
        points, at = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    return points, at


@dataclass
class Runs:
    """Three-letter runs of some texts: ``code`` counts in base of the size of ``alphabet``; ``owner`` is the text."""

    alphabet: np.ndarray
    code: np.ndarray
    owner: np.ndarray
    lettered: np.ndarray  # of each text

    def bound(self, codes: np.ndarray) -> np.ndarray:
        one = letter_vectors(self.alphabet)
        size = len(self.alphabet)
        return np.roll(one, 2, axis=1)[codes // size**2] * np.roll(one, 1, axis=1)[codes // size % size] * one[codes % size]

    def bundles(self, owner: np.ndarray, n: int) -> np.ndarray:
        """Vectors of ``n`` groups of runs; ``owner`` is the group of each run."""
        out = np.zeros((n, DIMENSIONS), np.float32)
        if len(self.alphabet) ** 3 <= 1 << 22:
            seen = np.zeros(len(self.alphabet) ** 3, bool)
            seen[self.code] = True
            present, place = np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[self.code]
        else:
            present, place = np.unique(self.code, return_inverse=True)
        order = np.argsort(owner, kind="stable") if (owner[1:] < owner[:-1]).any() else slice(None)
        owner, place = owner[order], place[order]
        for low in range(0, len(present), RUNS):
            some = self.bound(present[low : low + RUNS])
            if len(present) > RUNS:
                inside = (place >= low) & (place < low + RUNS)
                who, which = owner[inside], place[inside] - low
            else:
                who, which = owner, place
            for first in range(0, n, TOGETHER):
                a, b = np.searchsorted(who, [first, first + TOGETHER])
                if a < b:
                    texts = min(TOGETHER, n - first)
                    table = np.bincount((who[a:b] - first).astype(np.int64) * len(some) + which[a:b], minlength=texts * len(some))
                    out[first : first + texts] += table.reshape(texts, len(some)).astype(np.float32) @ some
        return out


def runs(data: np.ndarray, bounds: np.ndarray) -> Runs:
    """Letter runs of the texts; a run's middle is a letter, what stands between letters counts as one blank."""
    points, at = _points(data, bounds)
    number = _alphabet()[points]
    lettered = np.diff(np.append(0, np.cumsum(number > 0))[at]) > 0
    number = np.abs(number)
    owner = np.repeat(np.arange(len(at) - 1, dtype=np.int32), np.diff(at))
    again = np.append(False, (number[1:] == 0) & (number[:-1] == 0) & (owner[1:] == owner[:-1]))[: len(number)]
    number, owner = number[~again], owner[~again]
    seen = np.zeros(_POINTS, bool)
    seen[number] = True
    alphabet = np.flatnonzero(seen)
    if len(number) < 3:
        return Runs(alphabet, np.zeros(0, np.int64), np.zeros(0, np.int32), lettered)
    local = np.empty(_POINTS, np.int64)
    local[alphabet] = np.arange(len(alphabet))
    size, named = len(alphabet), local[number]
    code = (named[:-2] * size + named[1:-1]) * size + named[2:]
    whole = (owner[:-2] == owner[2:]) & (number[1:-1] > 0)
    return Runs(alphabet, code[whole], owner[:-2][whole], lettered)


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}

    def told() -> pa.RecordBatch:
        sums = pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))
        return pa.RecordBatch.from_pydict({"lang": pa.array(list(total), pa.string()), "sums": sums})

    for batch in batches:
        langs = batch.column(1).to_pylist()
        for begin, end, data, bounds in w.chunks(batch.column(0)):
            names, which = np.unique(np.array(langs[begin:end], object), return_inverse=True)
            found = runs(data, bounds)
            bundled = np.rint(found.bundles(which[found.owner], len(names))).astype(np.int64)
            for name, vector in zip(names, bundled):
                total[name] = total[name] + vector if name in total else vector
            if len(total) > LANGUAGES:
                yield told()
                total.clear()
    yield told()
    w.release()


@dataclass
class Profiles:
    """Languages and the sums of their texts' vectors, as a table dealt to blocks."""

    table: DataFrame  # lang, sums, block
    languages: int
    blocks: int

    def block(self, i: int) -> tuple[list[str], np.ndarray]:
        """Languages of a block by code point, and their unit vectors."""
        found = sorted(self.table.filter(F.col("block") == i).select("lang", "sums").collect(), key=lambda r: r.lang)
        x = np.array([r.sums for r in found], np.float64).reshape(len(found), DIMENSIONS)
        norm = np.linalg.norm(x, axis=1)
        return [r.lang for r, long in zip(found, norm) if long > 0], (x[norm > 0] / norm[norm > 0, None]).astype(np.float32)


def prototypes(labelled: DataFrame) -> Profiles:
    """Profiles of all languages, from all rows of (text, lang); languages without a run of letters have none."""
    given = labelled.select(w.text_of(labelled).alias("text"), F.col("lang").cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    each = given.mapInArrow(_training, "lang string, sums array<bigint>").select("lang", F.posexplode("sums").alias("dim", "n"))
    added = each.groupBy("lang", "dim").agg(F.sum("n").alias("n"))
    table = added.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "n"))), lambda x: x["n"]).alias("sums"))
    table = saved(table.filter(F.exists("sums", lambda x: x != 0)), "profiles")
    n = table.count()
    # Blocks by hash hold half of what is allowed on average.
    blocks = 1 if n <= LANGUAGES else -(-2 * n // LANGUAGES)
    return Profiles(table.withColumn("block", F.pmod(F.xxhash64("lang"), F.lit(blocks)).cast("int")), n, blocks)


def _nearest(shared):
    def compute(texts: pa.Array):
        names, profiles = shared.value
        best, score = np.full(len(texts), -1), np.full(len(texts), np.nan)
        for begin, end, data, bounds in w.chunks(texts.cast(pa.string())):
            if not len(names):
                continue
            found = runs(data, bounds)
            bundle = found.bundles(found.owner, end - begin)
            norm = np.sqrt((bundle * bundle).sum(axis=1))
            bundle /= np.where(norm > 0, norm, 1)[:, None]
            for first in range(0, end - begin, TOGETHER):
                last = min(first + TOGETHER, end - begin)
                cosine = bundle[first:last] @ profiles.T
                best[begin + first : begin + last] = np.where(found.lettered[first:last], cosine.argmax(axis=1), -1)
                score[begin + first : begin + last] = cosine.max(axis=1)
        return [names[b] if b >= 0 else None for b in best.tolist()], [s if b >= 0 else None for b, s in zip(best.tolist(), score.tolist())]

    return compute


def predict(docs: DataFrame, model: Profiles, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with lang_pred and score (the cosine, 0 to 1); and the new names."""
    context, out, names = docs.sparkSession.sparkContext, docs, []
    for i in range(model.blocks):
        shared = context.broadcast(model.block(i))
        out, found = rows.with_columns(out, "lang_pred string, score double", _nearest(shared), text)
        if names:  # the better one of this block and those before, by name if level
            (lang, score), (other, value) = map(F.col, names), map(F.col, found)
            better = (value > score) | ((value == score) & (other < lang))
            out = saved(out.select(*docs.columns, F.when(better, other).otherwise(lang).alias(names[0]), F.when(better, value).otherwise(score).alias(names[1])), "nearest")
            shared.unpersist()
        else:
            names = found
            if model.blocks > 1:
                out = saved(out, "nearest")
                shared.unpersist()
    lang, score = names
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(score, F.lit(0.0))))
    return out.withColumns({lang: F.coalesce(F.col(lang), F.lit("und")), score: clipped}), names
