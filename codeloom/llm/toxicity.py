"""Toxicity scores by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; the unlabelled are texts of the corpus. The
model sees which tokens and beginnings of words a text has, so one toxic word counts
the same in a long text as in a short one, and a new form of it counts too. NULL and empty texts have no token and get the score of the bias.
Columns are passed through; see ``pu`` for what is learnt from which rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from codeloom.llm import pu


def learn_toxicity(docs: DataFrame, labels: DataFrame, training: Column, label: str = "toxic", most: int = pu.MOST) -> pu.Model | None:
    return pu.learn(docs, labels, label, training, rate=False, use_shape=False, beyond=4.0, folds=4, stem=4, most=most)


def score_toxicity(docs: DataFrame, model: pu.Model | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    return pu.score(docs, model, text)
