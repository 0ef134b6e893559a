"""Tables of a data folder, and views that Spark derives from them.

The view texts are plain SQL that reads the same in Spark and in the checking
engine, so a check can repeat the view without repeating the operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import pinned

# Code files made from every document: the template depends on the id and carries
# the whole text (in a comment, a docstring or as it is), every
# third path is blank so that language detection has to look at the content.
CODE_PATH = """CASE WHEN doc_id % 3 = 0 THEN '' ELSE concat('src/f_', CAST(doc_id AS string),
    CASE CAST(doc_id % 8 AS int) WHEN 0 THEN '.py' WHEN 1 THEN '.PY' WHEN 2 THEN '.py' WHEN 3 THEN '.js'
      WHEN 4 THEN '.java' WHEN 5 THEN '.h' WHEN 6 THEN '.md' ELSE '.txt' END) END"""

CODE_TEXT = """CASE CAST(doc_id % 8 AS int)
  WHEN 0 THEN concat('import os', chr(10), chr(10), 'def f_', CAST(doc_id AS string), '(x):', chr(10), '    \"\"\"', translate(text, concat(chr(10), chr(13), chr(34), chr(92)), '    '), '\"\"\"', chr(10), '    y = x + ', CAST(doc_id % 7 AS string), chr(10), '    return y', chr(10))
  WHEN 1 THEN concat('import sys', chr(10), 'def g_', CAST(doc_id AS string), '(x', chr(10), '    return x', chr(10), '# ', translate(text, concat(chr(10), chr(13)), '  '), chr(10), 'print x', chr(10))
  WHEN 2 THEN concat('class C_', CAST(doc_id AS string), ':', chr(10), '    def m(self):', chr(10), '        print self', chr(10), chr(10), '    def n(self) -> int:', chr(10), '        return 1', chr(10), '# ', translate(text, concat(chr(10), chr(13)), '  '), chr(10))
  WHEN 3 THEN concat('function h_', CAST(doc_id AS string), '(a) {', chr(10), '  // ', translate(text, concat(chr(10), chr(13)), '  '), chr(10), '  var b = a;', chr(10), '  if (a == b) { return 1; }', chr(10), '  return b !== 2;', chr(10), '}', chr(10), 'const k = (z) => z;', chr(10), 'class K_', CAST(doc_id AS string), ' {}')
  WHEN 4 THEN concat('import java.util.*;', chr(10), 'public class J_', CAST(doc_id AS string), ' {', chr(10), '  public static void main(String[] a) {', chr(10), '    int n = ', CAST(doc_id % 11 AS string), ';', chr(10), '    // ', translate(text, concat(chr(10), chr(13)), '  '), chr(10), '  }', chr(10), '}')
  WHEN 5 THEN concat('#include <stdio.h>', chr(10), 'int main(void) {', chr(10), '  /* ', CAST(doc_id AS string), ' ', translate(text, concat(chr(10), chr(13)), '  '), ' */', chr(10), '  return 0;', chr(10), '}', chr(10))
  WHEN 6 THEN concat('# T', CAST(doc_id AS string), chr(10), text, chr(10), chr(10), '## A', chr(10), chr(10), text, chr(10), chr(10), text)
  ELSE text END"""

CODE_FILES_SQL = f"SELECT doc_id, lang AS natural_lang, source, {CODE_PATH} AS path, {CODE_TEXT} AS text FROM documents"

# Requests and replies made from every event. A request gets a reply ``k`` times
# 300 ms later unless ``k`` ends in 0; every seventh ``k`` an error; an event of
# type error also brings a reply that nobody asked for.
K_SQL = "CAST(regexp_extract(props, '[0-9]+', 0) AS int)"
REQUEST_TYPE = "CASE WHEN event_type IN ('view', 'click') THEN 'completion_request' ELSE 'chat_request' END"
REPLY_TYPE = f"CASE WHEN {K_SQL} % 7 = 0 THEN 'error' WHEN event_type IN ('view', 'click') THEN 'completion_response' ELSE 'chat_response' END"
REQUESTS_SQL = f"SELECT event_id, user_id, ts, {REQUEST_TYPE} AS type, concat('req_', event_id) AS request_id FROM events"
REPLIES_SQL = f"""SELECT event_id AS reply_id, ts + to_milliseconds({K_SQL} * 300) AS ts, concat('req_', event_id) AS request_id, {REPLY_TYPE} AS type
    FROM events WHERE {K_SQL} % 10 <> 0
    UNION ALL SELECT -1 - event_id, ts, concat('gone_', event_id), 'error' FROM events WHERE event_type = 'error'"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The document table, ready for work that costs much per byte of text.

    A file with one row group is read by one task. Where the scan has fewer
    tasks than the cluster has cores, the rows are spread over the cores; a
    large table is left as it is scanned.
    """
    scanned = table(spark, sf_dir, "documents")
    cores = spark.sparkContext.defaultParallelism
    if scanned.select("doc_id").rdd.getNumPartitions() < cores:
        return scanned.repartition(cores, "doc_id")
    return scanned


def code_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pinned(documents(spark, sf_dir).select("doc_id", F.col("lang").alias("natural_lang"), "source", F.col("text").alias("_raw")),
                  path=F.expr(CODE_PATH), text=F.expr(CODE_TEXT.replace("text", "_raw")))
    return made.drop("_raw")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_instants(table(spark, sf_dir, "events"))


def as_instants(rows: DataFrame) -> DataFrame:
    """Wall-clock times as instants in UTC, whatever the session's time zone."""
    return rows.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS timestamp)"))


def as_requests(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "event_id", "user_id", "ts", f"{REQUEST_TYPE} AS type", "concat('req_', CAST(event_id AS string)) AS request_id"
    )


def as_replies(rows: DataFrame) -> DataFrame:
    """One or two rows per event, made in one pass over the events."""
    k = "CAST(get_json_object(props, '$.k') AS int)"
    reply = f"""named_struct('reply_id', event_id, 'ts', ts + {k} * INTERVAL '0.3' SECOND,
        'request_id', concat('req_', CAST(event_id AS string)), 'type', {REPLY_TYPE})"""
    stray = """named_struct('reply_id', -1 - event_id, 'ts', ts,
        'request_id', concat('gone_', CAST(event_id AS string)), 'type', 'error')"""
    either = f"array(CASE WHEN {k} % 10 <> 0 THEN {reply} END, CASE WHEN event_type = 'error' THEN {stray} END)"
    return rows.selectExpr(f"inline(filter({either}, r -> r IS NOT NULL))")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_requests(events(spark, sf_dir))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_replies(events(spark, sf_dir))


def md5_list(array) -> "F.Column":
    """Digest of an array's items, to compare long arrays by one value."""
    return F.md5(F.array_join(array, ","))
