"""Curation steps on (doc_id, text): copies, repetition, generated code, stop sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx

# Sequences at which a generated text ends.
STOP_SEQUENCES = ("\n\n\n", "</s>", "<|endoftext|>")
MAX_REPETITION = 0.3
#: Words that tools leave in the files they write; the rule is our own.
GENERATED_MARKERS = ("do not edit", "auto-generated", "autogenerated", "generated by", "@generated")


def exact_classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The smallest id of every distinct text, and how many rows have the text.

    Only digests are shuffled, and copies are counted before the shuffle.
    """
    digest = F.sha2(F.col(text).cast("binary"), 256)
    return docs.groupBy(digest.alias("digest")).agg(F.min(id_col).alias(id_col), F.count(F.lit(1)).alias("n_copies"))


def repetition_ratio(text: Column) -> Column:
    """Share of lines that repeat an earlier line of the text."""
    return tx.let(tx.lines(text), lambda parts: 1 - F.size(F.array_distinct(parts)).cast("double") / F.size(parts))


def is_generated(text: Column) -> Column:
    return tx.contains_any(F.lower(text), GENERATED_MARKERS)


def cut_at_stop(text: Column, stops: Sequence[str] = STOP_SEQUENCES) -> Column:
    """The text up to the first of the stop sequences, all of it if there is none."""
    ends = [F.when(F.contains(text, F.lit(stop)), F.length(F.substring_index(text, stop, 1))) for stop in stops]
    first = F.coalesce(F.least(*ends), F.length(text))
    return F.substring(text, F.lit(1), first)
