"""Positive-unlabelled learning of text classifiers in numpy.

A linear model over words and marks is fitted to the non-negative unbiased risk

    prior * E_P[loss(f)] + max(0, E_U[loss(-f)] - prior * E_P[loss(-f)])

of confirmed positives P and unlabelled texts U. No label but the positives is read.
The texts are dealt to folds, and each fold's texts judged by a model of the others.
The prior is estimated from these outputs: whatever the cut, U has at least prior times
the share of P above it, and the cut that bounds the prior best decides. Scores are
calibrated by a logistic curve of the same risk, on outputs of texts not fitted.

Fitting reads at most ``most`` positives and ``most`` unlabelled texts, those of least
hash of their id, one text for an id; scoring reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm import rows, words as w

MOST = 4000
RARE = 3  # a word of fewer fitted texts is not a feature
_MARKS = ~(w.ALNUM | ~w.NON_SPACE)
_CLASSES = {
    "digit": np.isin(np.arange(256), np.arange(0x30, 0x3A)),
    "upper": np.isin(np.arange(256), np.arange(0x41, 0x5B)),
    "mark": _MARKS,
    "wide": np.arange(256) >= 0x80,
    "line": np.arange(256) == 10,
}
N_SHAPE = len(_CLASSES) + 5  # figures of a text


def _counted(owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens of each text, and how often it has them."""
    order = np.argsort(token, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, token = owner[order], token[order]
    new = np.append(True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])) if len(token) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    return owner[heads], token[heads], np.diff(np.append(heads, len(token)))


def read(data: np.ndarray, bounds: np.ndarray, stem: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: distinct tokens (text, hash, count), and figures of the texts' shape.

    With ``stem``, the first so many bytes of each longer word are a token too.
    """
    n = len(bounds) - 1
    owners, found = [], []
    for keep, salt in ((w.ALNUM, 0), (_MARKS, 1)):
        starts, ends, first = w.cut(data, bounds, keep)
        found.append(w.hashes(data, starts, ends, lower=True) ^ np.uint64(salt))
        owners.append(np.repeat(np.arange(n), np.diff(first)))
    n_words, n_marks = np.bincount(owners[0], minlength=n), np.bincount(owners[1], minlength=n)
    owner, token, count = _counted(np.concatenate(owners), np.concatenate(found))
    size = np.maximum(np.diff(bounds), 1)
    of = lambda table: np.diff(np.append(0, np.cumsum(table[data]))[bounds])
    shape = [np.log1p(np.diff(bounds)), *(of(t) / size for t in _CLASSES.values())]
    n_tokens = np.maximum(n_words + n_marks, 1)
    shape += [n_marks / n_tokens, size / n_tokens, np.bincount(owner, minlength=n) / n_tokens, np.bincount(owner, count * (count > 1), minlength=n) / n_tokens]
    if stem:
        starts, ends, first = w.cut(data, bounds, w.ALNUM)
        long = ends - starts > stem
        begun = _counted(np.repeat(np.arange(n), np.diff(first))[long], w.hashes(data, starts[long], starts[long] + stem, lower=True) ^ np.uint64(2))
        owner, token, count = (np.concatenate(pair) for pair in zip((owner, token, count), begun))
        order = np.argsort(owner, kind="stable")
        owner, token, count = owner[order], token[order], count[order]
    return owner, token, count, np.stack(shape, axis=1).astype(np.float64)


@dataclass
class Model:
    """Weights of known tokens and of the shape, and the curve from output to score."""

    known: np.ndarray
    weight: np.ndarray
    shape_mean: np.ndarray
    shape_scale: np.ndarray
    shape_weight: np.ndarray
    bias: float
    rate: bool
    stem: int = 0
    slope: float = 1.0
    shift: float = 0.0

    def values(self, owner: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
        """1 for a token's presence, or its share of the text's tokens (in units of 5 %)."""
        if not self.rate:
            return np.ones(len(owner))
        return 20 * count / np.maximum(np.bincount(owner, count, minlength=n), 1)[owner]

    def output(self, owner, token, count, shape) -> np.ndarray:
        n = len(shape)
        out = (shape - self.shape_mean) / self.shape_scale @ self.shape_weight + self.bias
        if len(self.known) and len(token):
            at = np.minimum(np.searchsorted(self.known, token), len(self.known) - 1)
            hit = self.known[at] == token
            out = out + np.bincount(owner[hit], (self.weight[at] * self.values(owner, count, n))[hit], minlength=n)
        return out

    def scores(self, output: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * output + self.shift, -30, 30)))


def fit(positive: list, unlabelled: list, prior: float, rate: bool, use_shape: bool, beyond: float, steps: int = 300, pace: float = 0.05, decay: float = 1e-3) -> Model:
    """Full-batch descent (Adam) on the risk; each text begins with tokens, counts, shape."""
    texts = [*positive, *unlabelled]
    n, n_pos = len(texts), len(positive)
    owner = np.repeat(np.arange(n), [len(t[0]) for t in texts])
    token = np.concatenate([t[0] for t in texts])
    count = np.concatenate([t[1] for t in texts])
    shape = np.array([t[2] for t in texts])
    known, place, seen = np.unique(token, return_inverse=True, return_counts=True)
    # Tokens whose share of the positives differs from that of the unlabelled by so many standard errors.
    with_p = np.bincount(place, owner < n_pos, minlength=len(known))
    pooled = seen / n
    error = np.sqrt(pooled * (1 - pooled) * (1 / n_pos + 1 / (n - n_pos)))
    apart = np.abs(with_p / n_pos - (seen - with_p) / (n - n_pos))
    often = (seen >= RARE) & (apart > beyond * error)
    number = np.cumsum(often) - 1
    model = Model(known[often], np.zeros(often.sum()), shape.mean(axis=0), np.maximum(shape.std(axis=0), 1e-6), np.zeros(shape.shape[1]), 0.0, rate)
    value = model.values(owner, count, n)
    keep = often[place]
    owner, column, value = owner[keep], number[place[keep]], value[keep]
    standard = (shape - model.shape_mean) / model.shape_scale * (1.0 if use_shape else 0.0)
    theta = np.zeros(len(model.weight) + shape.shape[1] + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    m, d = len(model.weight), shape.shape[1]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for step in range(1, steps + 1):
        f = np.bincount(owner, value * theta[column], minlength=n) + standard @ theta[m : m + d] + theta[-1]
        p, u = f[:n_pos], f[n_pos:]
        # Slopes of the logistic losses log(1 + exp(-f)) and log(1 + exp(f)).
        negative = np.logaddexp(0, u).mean() - prior * np.logaddexp(0, p).mean()
        slope = np.zeros(n)
        if negative >= 0:
            slope[:n_pos] = (-prior * sigmoid(-p) - prior * sigmoid(p)) / n_pos
            slope[n_pos:] = sigmoid(u) / len(u)
        else:  # the risk of the negatives went below zero: step back from it
            slope[:n_pos] = prior * sigmoid(p) / n_pos
            slope[n_pos:] = -sigmoid(u) / len(u)
        gradient = np.concatenate([np.bincount(column, value * slope[owner], minlength=m), standard.T @ slope, [slope.sum()]])
        gradient[: m + d] += decay * theta[: m + d]
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta -= pace * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    model.weight, model.shape_weight, model.bias = theta[:m], theta[m : m + d] * (1.0 if use_shape else 0.0), float(theta[-1])
    return model


def outputs(model: Model, texts: list) -> np.ndarray:
    owner = np.repeat(np.arange(len(texts)), [len(t[0]) for t in texts])
    join = lambda k: np.concatenate([t[k] for t in texts])
    return model.output(owner, join(0), join(1), np.array([t[2] for t in texts]))


def held_out(positive: list, unlabelled: list, folds: int, train) -> tuple[np.ndarray, np.ndarray]:
    """Outputs of the positives and the unlabelled by models that ``train`` makes from the other folds.

    A text that is in both sets is in one fold: its number, last in the tuple, decides.
    Folds are put on one scale by the median and the spread of their unlabelled texts. One fold is judged by its own model.
    """
    found: tuple[list, list] = [], []
    for fold in range(folds):
        inside = [[t for t in side if t[3] % folds == fold] for side in (positive, unlabelled)]
        outside = inside if folds == 1 else [[t for t in side if t[3] % folds != fold] for side in (positive, unlabelled)]
        model = train(*outside)
        made = [outputs(model, side) for side in inside]
        middle, spread = scale(made[1])
        for kept, out in zip(found, made):
            kept.append((out - middle) / spread)
    return np.concatenate(found[0]), np.concatenate(found[1])


def scale(output: np.ndarray) -> tuple[float, float]:
    return float(np.median(output)), max(float(output.std()), 1e-6)


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, doubt: float = 0.1) -> float:
    """Share of positives among the unlabelled, from outputs of both.

    Of all cuts, that with the least upper bound (at confidence 1 - ``doubt``) of the
    ratio of the shares above it, unlabelled to positive; the prior is its ratio.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    above = lambda side: 1 - np.searchsorted(np.sort(side), cuts) / len(side)
    of_p, of_u = above(positive), above(unlabelled)
    some = of_p > 0
    of_p, of_u = of_p[some], of_u[some]
    error = sum(np.sqrt(np.log(4 / doubt) / 2 / len(side)) for side in (positive, unlabelled))
    best = np.argmin((of_u + error) / of_p)
    return float(np.clip(of_u[best] / of_p[best], 1e-3, 1 - 1e-3))


def curve(positive: np.ndarray, unlabelled: np.ndarray, prior: float, pull: float = 1e-3) -> tuple[float, float]:
    """Slope and shift of the logistic curve of least unbiased risk, by Newton steps.

    The risk of a positive with loss log(1 + exp(-z)), less its part in the unlabelled,
    log(1 + exp(z)), is -z: the whole is convex. ``pull`` holds the slope, which has
    no end where all outputs are told apart.
    """
    x = np.stack([unlabelled, np.ones(len(unlabelled))], axis=1)
    mean = np.array([positive.mean(), 1.0])
    theta = np.array([1.0, 0.0])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        gradient = x.T @ p / len(x) - prior * mean + pull * theta * [1, 0]
        hessian = (x * (p * (1 - p))[:, None]).T @ x / len(x) + pull * np.eye(2)
        theta -= np.clip(np.linalg.solve(hessian, gradient), -1, 1)
    return float(theta[0]), float(theta[1])


def learned(positive: list, unlabelled: list, folds: int, pull: float = 1e-3, **how) -> tuple[Model, float]:
    """The calibrated model of positives and unlabelled texts, and the prior estimated on the way."""
    folds = max(1, min(folds, len(positive), len(unlabelled)))
    prior = class_prior(*held_out(positive, unlabelled, folds, lambda p, u: fit(p, u, 0.5, **how)))
    judged = held_out(positive, unlabelled, folds, lambda p, u: fit(p, u, prior, **how))
    prior = class_prior(*judged)  # anew: these models were fitted at the first estimate
    model = fit(positive, unlabelled, prior, **how)
    middle, spread = scale(outputs(model, unlabelled))
    slope, shift = curve(*judged, prior, pull)
    model.slope, model.shift = slope / spread, shift - slope * middle / spread
    return model, prior


def _features(batches: Iterator[pa.RecordBatch], stem: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, bounds in w.chunks(batch.column(1)):
            owner, token, count, shape = read(data, bounds, stem)
            cuts = np.searchsorted(owner, np.arange(1, end - begin))
            yield pa.RecordBatch.from_pydict(
                {
                    "roles": batch.column(0).slice(begin, end - begin),
                    "tokens": pa.array([t.tobytes() for t in np.split(token, cuts)], pa.binary()),
                    "counts": pa.array([c.astype(np.int32).tobytes() for c in np.split(count, cuts)], pa.binary()),
                    "shape": pa.array([s.tobytes() for s in shape], pa.binary()),
                }
            )


def learn(
    docs: DataFrame, labels: DataFrame, label: str, training: Column, rate: bool, use_shape: bool, beyond: float,
    folds: int, pull: float = 1e-3, stem: int = 0, most: int = MOST,
) -> Model | None:
    """The classifier of ``label`` from the rows labelled 1 that ``training``, a condition on doc_id, admits.

    Labels of other rows, NULL labels and doc_ids are not read; a doc_id with several
    labels has the largest. Without a positive, there is nothing to learn: None.
    """
    known = labels.filter(training & (F.col(label) == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    plain = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").distinct()
    some = lambda frame, salt, role: frame.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(most).select("doc_id", F.lit(role).alias("role"))
    picked = some(known, 31, "p").union(some(plain, 32, "u"))
    # At most 2 * most ids, a bounded table.
    chosen = F.broadcast(picked.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_set("role")), "").alias("_roles")))
    texts = docs.select("doc_id", w.text_of(docs).alias("text")).join(chosen, "doc_id")
    texts = texts.groupBy("doc_id", "_roles").agg(F.min("text").alias("text")).select("_roles", "text")
    got = texts.mapInArrow(lambda batches: _features(batches, stem), "roles string, tokens binary, counts binary, shape binary").collect()
    got.sort(key=lambda r: (r["roles"], bytes(r["tokens"]), bytes(r["counts"])))
    sets: dict[str, list] = {"p": [], "u": []}
    for number, r in enumerate(got):  # in order of roles, so that each set is dealt evenly
        text = np.frombuffer(r["tokens"], np.uint64), np.frombuffer(r["counts"], np.int32).astype(np.int64), np.frombuffer(r["shape"], np.float64), number
        for role in r["roles"]:
            sets[role].append(text)
    if not sets["p"] or not sets["u"]:
        return None
    model, _ = learned(sets["p"], sets["u"], folds, pull, rate=rate, use_shape=use_shape, beyond=beyond)
    model.stem = stem
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with their score (0 to 1; 0.5 without a model); and the new name."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def compute(texts: pa.Array):
        out = np.full(len(texts), 0.5)
        if shared.value is not None:
            for begin, end, data, bounds in w.chunks(texts.cast(pa.string())):
                out[begin:end] = shared.value.scores(shared.value.output(*read(data, bounds, shared.value.stem)))
        return [out]

    return rows.with_columns(docs, "score double", compute, text)
