"""Evaluation, connection, run and acceptance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.operators import metrics
from codeloom.operators.ranking import first_n
from codeloom.plans.registry import query
from codeloom.plans.views import K_SQL, table
from codeloom.session import shared_dir
from codeloom.sources import files
from codeloom.streaming.messages import reconnect_delay_ms


@query(
    """WITH t AS (SELECT vec_id // 16 AS seq, vec_id % 16 AS pos, embedding::double[] AS x,
        CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS label FROM embeddings),
      shifted AS (SELECT x, lead(label) OVER (PARTITION BY seq ORDER BY pos) AS y FROM t),
      scored AS (SELECT ln(list_sum(list_transform(x, lambda v: exp(v - list_max(x))))) + list_max(x) - x[y + 1] AS loss,
        (list_position(x, list_max(x)) - 1 = y)::double AS hit FROM shifted WHERE y <> -100)
      SELECT count(*) AS n_tokens, round(avg(loss), 6) AS eval_loss, round(exp(avg(loss)), 6) AS perplexity, round(coalesce(avg(hit), 0), 6) AS accuracy FROM scored"""
)
def lm_metrics(spark, sf_dir):
    """The vectors stand in for logits: sequences of 16 positions, some labels ignored."""
    tokens = table(spark, sf_dir, "embeddings").selectExpr(
        "vec_id div 16 AS seq_id", "vec_id % 16 AS pos", "embedding AS logits", "CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS label"
    )
    found = metrics.next_token_metrics(tokens)
    return found.select("n_tokens", *[F.round(c, 6).alias(c) for c in ("eval_loss", "perplexity", "accuracy")])


@query(
    """WITH each AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'purchase')) AS s,
        count(*) FILTER (event_type IN ('click', 'signup')) AS r, min(epoch_us(ts)) AS first_at FROM events GROUP BY user_id)
      SELECT user_id, count(*) AS connections, sum(s)::bigint AS messages_sent, sum(r)::bigint AS messages_received, min(first_at) AS connected_at
      FROM each GROUP BY ROLLUP (user_id)"""
)
def connection_stats(spark, sf_dir):
    kind = F.col("event_type")
    return metrics.connection_stats(
        table(spark, sf_dir, "events"), "user_id", kind.isin("view", "purchase"), kind.isin("click", "signup"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"),
    )


# Purchases stand in for runs that passed, errors for runs that failed.
@query(
    f"""WITH runs AS (SELECT concat('m', user_id % 7) AS model_type, event_type = 'purchase' AS ok, {K_SQL} AS k, value, ts, event_id
        FROM events WHERE event_type IN ('purchase', 'error')),
      latest AS (SELECT model_type, count(*) AS n_runs, count(*) FILTER (ok) AS n_passed, arg_max(event_id, concat(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '-', event_id)) AS event_id FROM runs GROUP BY model_type)
      SELECT model_type, n_runs, n_passed, ok AS success, CASE WHEN ok THEN concat(k, 's') END AS duration,
        CASE WHEN ok THEN k % 4 END AS epochs, CASE WHEN ok THEN value END AS train_loss, CASE WHEN ok THEN value + 1 END AS eval_loss,
        CASE WHEN ok THEN value * 2 END AS perplexity,
        CASE WHEN NOT ok THEN CASE WHEN k % 2 = 0 THEN concat('failed ', k) ELSE 'Unknown error' END END AS error
      FROM latest JOIN runs USING (model_type, event_id)"""
)
def run_summary(spark, sf_dir):
    """Run results written as JSON, read back, and summed up per model."""
    runs = table(spark, sf_dir, "events").filter("event_type IN ('purchase', 'error')").selectExpr(
        "*", "event_type = 'purchase' AS success", "CAST(get_json_object(props, '$.k') AS int) AS k"
    )
    results = runs.selectExpr(
        "concat('m', user_id % 7) AS model_type",
        "concat(date_format(ts, 'yyyy-MM-dd HH:mm:ss.SSSSSS'), '-', event_id) AS start_time",
        "CASE WHEN success THEN concat(k, 's') END AS duration",
        "CASE WHEN success THEN map('epoch', CAST(k % 4 AS double), 'train_loss', value) END AS train_metrics",
        "CASE WHEN success THEN map('eval_loss', value + 1, 'perplexity', value * 2) END AS eval_metrics",
        "CASE WHEN NOT success AND k % 2 = 0 THEN concat('failed ', k) END AS error",
        "success",
    )
    folder = shared_dir(spark, "runs")
    files.write_runs(results, folder)
    return metrics.run_summary(files.read_runs(spark, folder), F.col("start_time"))


@query(
    f"""SELECT user_id, count(*) AS n_accepted, round(avg({K_SQL} / 100.0::double), 6) AS avg_confidence, round(avg({K_SQL} * 3), 6) AS avg_length
      FROM events WHERE event_type = 'click' GROUP BY user_id"""
)
def acceptance_stats(spark, sf_dir):
    accepted = table(spark, sf_dir, "events").filter("event_type = 'click'").selectExpr(
        "user_id", "CAST(get_json_object(props, '$.k') AS int) / 100.0D AS confidence", "CAST(get_json_object(props, '$.k') AS int) * 3 AS suggestion_length"
    )
    stats = metrics.acceptance_stats(accepted, "user_id")
    return stats.select("user_id", "n_accepted", F.round("avg_confidence", 6).alias("avg_confidence"), F.round("avg_length", 6).alias("avg_length"))


@query(
    """SELECT user_id, day, attempt, least(1000 * 2 ** attempt, 30000)::bigint AS delay_ms, event_id FROM (
        SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_id, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts, event_id) - 1 AS attempt
        FROM events WHERE event_type = 'error') WHERE attempt < 5"""
)
def backoff_schedule(spark, sf_dir):
    """Errors of a day as failed connects: the first five get a reconnect delay."""
    failed = table(spark, sf_dir, "events").filter("event_type = 'error'").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    tries = first_n(failed, ["user_id", "day"], [F.col("ts"), F.col("event_id")], 5).withColumn("attempt", F.col("rank") - 1)
    return tries.select("user_id", "day", "attempt", reconnect_delay_ms(F.col("attempt")).alias("delay_ms"), "event_id")
