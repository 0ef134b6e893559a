"""Evaluation metrics, connection totals, run summaries, acceptance figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from codeloom.functions.text import let

# Fixed value: label of positions that do not count.
IGNORED_LABEL = -100


def cross_entropy(logits: Column, label: Column) -> Column:
    """Negative log softmax of the label's logit, in doubles."""

    def loss(x: Column) -> Column:
        top = F.array_max(x)
        total = F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - top))
        return F.log(total) + top - F.get(x, label)

    return let(logits.cast("array<double>"), loss)


def arg_max(logits: Column) -> Column:
    return let(logits, lambda x: (F.array_position(x, F.array_max(x)) - 1).cast("int"))


def next_token_metrics(tokens: DataFrame, sequence: str = "seq_id", position: str = "pos") -> DataFrame:
    """Loss, perplexity and accuracy of predicting each next token.

    ``tokens``: one row per position with ``logits`` and ``label``. The logits
    of a position are held against the label of the next; a sequence is at most
    as long as the model's window, which bounds the window partitions here.
    """
    following = F.lead("label").over(Window.partitionBy(sequence).orderBy(position))
    pairs = tokens.withColumn("next_label", following).filter(
        F.col("next_label").isNotNull() & (F.col("next_label") != IGNORED_LABEL)
    )
    scored = pairs.select(
        cross_entropy(F.col("logits"), F.col("next_label")).alias("loss"),
        (arg_max(F.col("logits")) == F.col("next_label")).cast("double").alias("hit"),
    )
    return scored.agg(
        F.count(F.lit(1)).alias("n_tokens"),
        F.avg("loss").alias("eval_loss"),
        F.exp(F.avg("loss")).alias("perplexity"),
        F.coalesce(F.avg("hit"), F.lit(0.0)).alias("accuracy"),
    )


def connection_stats(messages: DataFrame, connection: str, sent: Column, received: Column, at: Column) -> DataFrame:
    """Counters of every connection, and the totals where the connection is NULL."""
    each = messages.groupBy(connection).agg(
        F.count_if(sent).alias("sent"), F.count_if(received).alias("received"), F.min(at).alias("connected_at")
    )
    return each.rollup(connection).agg(
        F.count(F.lit(1)).alias("connections"),
        F.sum("sent").alias("messages_sent"),
        F.sum("received").alias("messages_received"),
        F.min("connected_at").alias("connected_at"),
    )


def run_summary(runs: DataFrame, saved_at: Column) -> DataFrame:
    """Per model: runs and passes, and the latest run's metrics or error."""
    latest = F.struct(
        "success",
        "duration",
        F.try_element_at("train_metrics", F.lit("epoch")).alias("epochs"),
        F.try_element_at("train_metrics", F.lit("train_loss")).alias("train_loss"),
        F.try_element_at("eval_metrics", F.lit("eval_loss")).alias("eval_loss"),
        F.try_element_at("eval_metrics", F.lit("perplexity")).alias("perplexity"),
        F.when(~F.col("success"), F.coalesce("error", F.lit("Unknown error"))).alias("error"),
    )
    summary = runs.groupBy("model_type").agg(
        F.count(F.lit(1)).alias("n_runs"), F.count_if(F.col("success")).alias("n_passed"), F.max_by(latest, saved_at).alias("_l")
    )
    return summary.select("model_type", "n_runs", "n_passed", "_l.*")


def acceptance_stats(accepted: DataFrame, *keys: str) -> DataFrame:
    """How many suggestions were taken, how sure they were and how long."""
    return accepted.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_accepted"),
        F.avg("confidence").alias("avg_confidence"),
        F.avg("suggestion_length").alias("avg_length"),
    )
