"""Quality scores by positive-unlabelled learning.

Trusted positives are texts labelled 1; the unlabelled are texts of the corpus. The
model sees each token's share of a text and figures of its shape (lengths, kinds of
characters, repetition). NULL and empty texts are scored by their empty shape.
Columns are passed through; see ``pu`` for what is learnt from which rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from codeloom.llm import pu


def learn_quality(docs: DataFrame, labels: DataFrame, training: Column, label: str = "quality", most: int = pu.MOST) -> pu.Model | None:
    return pu.learn(docs, labels, label, training, rate=True, use_shape=True, beyond=0.0, folds=2, pull=1e-4, most=most)


def score_quality(docs: DataFrame, model: pu.Model | None, text: str = "text") -> tuple[DataFrame, list[str]]:
    return pu.score(docs, model, text)
