"""Segment, chunk and line-check queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import segments as sg
from codeloom.plans.corpus import FILES_CTE, files
from codeloom.plans.registry import query
from codeloom.plans.views import code_files, documents

LINES = "string_split(text, chr(10))"


def words_sql(text: str) -> str:
    return f"len(regexp_extract_all({text}, '[^{tx.BLANK}]+'))"


# Files cut by line numbers: needs a relation ``cuts(doc_id, text, type, name, s, e, piece)``.
CUT_SQL = """SELECT doc_id, CAST(piece AS bigint) AS piece, type, name, CAST(s AS bigint) AS start_line, CAST(e AS bigint) AS end_line,
      md5(array_to_string(string_split(text, chr(10))[s + 1:e], chr(10))) AS digest FROM cuts"""

# The only template that parses holds one function, on lines 2 to 5.
PYTHON_CUTS = f"""SELECT doc_id, text, CASE WHEN doc_id % 8 = 0 THEN 'function' ELSE 'file' END AS type,
      CASE WHEN doc_id % 8 = 0 THEN concat('f_', doc_id) ELSE 'main' END AS name,
      CASE WHEN doc_id % 8 = 0 THEN 2 ELSE 0 END AS s,
      CASE WHEN doc_id % 8 = 0 THEN 6 ELSE len({LINES}) END AS e, 0 AS piece FROM files WHERE language = 'python'"""

JS_CUTS = f"""SELECT doc_id, text, type, name, s, e, row_number() OVER (PARTITION BY doc_id ORDER BY s, type DESC) - 1 AS piece FROM (
      SELECT doc_id, text, 'function' AS type, s, least(s + 20, n) AS e,
        coalesce(nullif(regexp_extract(line, '{{fn}}', 1), ''), nullif(regexp_extract(line, '{{fn}}', 2), '')) AS name
      FROM lined WHERE regexp_matches(line, '{{fn}}')
      UNION ALL SELECT doc_id, text, 'class', s, least(s + 30, n), regexp_extract(line, '{{cl}}', 1) FROM lined WHERE regexp_matches(line, '{{cl}}')
      UNION ALL SELECT doc_id, text, 'file', 0, len({LINES}), 'main' FROM js WHERE doc_id NOT IN
        (SELECT doc_id FROM lined WHERE regexp_matches(line, '{{fn}}') OR regexp_matches(line, '{{cl}}')))""".format(
    fn=sg.JS_FUNCTION, cl=sg.JS_CLASS
)
JS_LINED = f"""lined AS (SELECT doc_id, text, n, CAST(unnest(range(n)) AS int) AS s, unnest(l) AS line
      FROM (SELECT doc_id, text, {LINES} AS l, len({LINES}) AS n FROM js))"""

GENERIC_CUTS = f"""SELECT doc_id, text, 'segment' AS type, concat('segment_', piece) AS name, piece, s,
      coalesce(lead(s) OVER (PARTITION BY doc_id ORDER BY s), n) AS e FROM (
      SELECT doc_id, text, n, s, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS piece FROM (
        SELECT doc_id, text, len({LINES}) AS n, unnest(range(len({LINES}))) AS s, unnest({LINES}) AS line FROM gen)
      WHERE s = 0 OR regexp_matches(line, '{sg.GENERIC_START}'))"""


def _segments(df):
    pieces = sg.explode_pieces(df, "segments", "doc_id")
    return pieces.select("doc_id", "piece", "type", "name", "start_line", "end_line", F.md5("code").alias("digest"))


@query(f"{FILES_CTE}, cuts AS ({PYTHON_CUTS}) {CUT_SQL}")
def segment_python(spark, sf_dir):
    return _segments(sg.python_file_segments(files(spark, sf_dir).filter("language = 'python'")))


@query(f"{FILES_CTE}, js AS (SELECT * FROM files), {JS_LINED}, cuts AS ({JS_CUTS}) {CUT_SQL}")
def segment_js(spark, sf_dir):
    return _segments(code_files(spark, sf_dir).withColumn("segments", sg.js_segments(F.col("text"))))


@query(f"{FILES_CTE}, gen AS (SELECT * FROM files), cuts AS ({GENERIC_CUTS}) {CUT_SQL}")
def segment_generic(spark, sf_dir):
    return _segments(code_files(spark, sf_dir).withColumn("segments", sg.generic_segments(F.col("text"))))


@query(
    f"""{FILES_CTE}, js AS (SELECT * FROM files WHERE language IN ('javascript', 'typescript')), {JS_LINED},
      gen AS (SELECT * FROM files WHERE language NOT IN ('python', 'javascript', 'typescript')),
      cuts AS (SELECT doc_id, text, type, name, s, e, piece FROM ({PYTHON_CUTS})
        UNION ALL SELECT doc_id, text, type, name, s, e, piece FROM ({JS_CUTS})
        UNION ALL SELECT doc_id, text, type, name, s, e, piece FROM ({GENERIC_CUTS})) {CUT_SQL}"""
)
def segment_code(spark, sf_dir):
    return _segments(sg.code_segments(files(spark, sf_dir)))


# Markdown sections: a header line opens one, and so does a stretch between
# headers that begins with "#". The last section is cut at blank lines.
_TRIM = f"trim({{0}}, '{tx.BLANK}')"
MARKDOWN_CTE = f"""lined AS (SELECT doc_id, unnest(range(len({LINES}))) AS i, unnest({LINES}) AS line FROM md),
    runs AS (SELECT doc_id, i, line, regexp_matches(line, '^#+ ') AS head,
        sum(CASE WHEN regexp_matches(line, '^#+ ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS h FROM lined),
    parts AS (SELECT doc_id, h, CASE WHEN head THEN 0 ELSE 1 END AS k,
        CASE WHEN head THEN {_TRIM.format("any_value(line)")} ELSE
          CASE WHEN h > 0 THEN chr(10) ELSE '' END || string_agg(line, chr(10) ORDER BY i) || chr(10) END AS part
      FROM runs GROUP BY doc_id, h, head),
    opened AS (SELECT *, CASE WHEN k = 0 THEN true ELSE starts_with({_TRIM.format("part")}, '#') END AS opens FROM parts),
    grouped AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY h, k) AS section FROM opened),
    sections AS (SELECT doc_id, section, string_agg(CASE WHEN opens THEN {_TRIM.format("part")} || chr(10) ELSE part END, '' ORDER BY h, k) AS s
      FROM grouped GROUP BY doc_id, section),
    cut AS (SELECT doc_id, section, CASE WHEN section = max(section) OVER (PARTITION BY doc_id)
        THEN string_split(s, chr(10) || chr(10)) ELSE [s] END AS p FROM sections),
    md_chunks AS (SELECT doc_id, {_TRIM.format("unnest(p)")} AS t, section, unnest(range(len(p))) AS j FROM cut)"""
MARKDOWN_KEPT = f"SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY section, j) - 1 AS piece FROM md_chunks WHERE {words_sql('t')} > 10"


@query(
    f"""{FILES_CTE}, md AS (SELECT * FROM files), {MARKDOWN_CTE}
      SELECT doc_id, CAST(piece AS bigint) AS piece, length(t) AS n_chars, md5(t) AS digest FROM ({MARKDOWN_KEPT})"""
)
def chunk_markdown(spark, sf_dir):
    chunked = code_files(spark, sf_dir).withColumn("chunks", sg.markdown_chunks(F.col("text")))
    pieces = sg.explode_pieces(chunked, "chunks", "doc_id")
    return pieces.select("doc_id", "piece", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def windows_sql(relation: str) -> str:
    return f"""SELECT doc_id, s, t, row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1 AS piece FROM (
      SELECT doc_id, s, array_to_string(l[s + 1:s + 20], chr(10)) AS t FROM (
        SELECT doc_id, l, unnest(range(0, len(l), 15)) AS s FROM (
          SELECT doc_id, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM (
            SELECT doc_id, string_split_regex(text, '{tx.LINE_BREAK}') AS l FROM {relation}))))
    WHERE {words_sql('t')} > 5"""


@query(
    f"""SELECT doc_id, CAST(piece AS bigint) AS piece, s AS start, s + 20 AS "end", length(t) AS n_chars, md5(t) AS digest
      FROM ({windows_sql('documents')})"""
)
def chunk_lines(spark, sf_dir):
    chunked = documents(spark, sf_dir).select("doc_id", sg.line_chunks(F.col("text")).alias("chunks"))
    pieces = sg.explode_pieces(chunked, "chunks", "doc_id")
    return pieces.select("doc_id", "piece", "start", "end", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(
    f"""{FILES_CTE} SELECT doc_id, 0 AS piece, 'FunctionDef' AS type, concat('f_', doc_id) AS name, 2 AS start, 6 AS "end",
      md5(array_to_string({LINES}[3:6], chr(10))) AS digest FROM files WHERE doc_id % 8 = 0"""
)
def chunk_python(spark, sf_dir):
    pieces = sg.explode_pieces(sg.python_file_chunks(code_files(spark, sf_dir)), "chunks", "doc_id")
    return pieces.select("doc_id", "piece", "type", "name", "start", "end", F.md5("text").alias("digest"))


PROJECT_CTE = f"""{FILES_CTE}, typed AS (SELECT *, lower(regexp_extract(path, '([.][^./]+)$', 1)) AS ext FROM files),
    md AS (SELECT * FROM typed WHERE ext IN ('.md', '.txt')), {MARKDOWN_CTE},
    py AS (SELECT * FROM typed WHERE ext = '.py' AND doc_id % 8 = 0),
    other AS (SELECT * FROM typed WHERE ext IN ('.js', '.ts', '.java', '.go', '.cpp', '.c', '.cs', '.rb') OR (ext = '.py' AND doc_id % 8 <> 0)),
    chunks AS (SELECT doc_id, piece, 'doc' AS type, t FROM ({MARKDOWN_KEPT})
      UNION ALL SELECT doc_id, 0, 'FunctionDef', array_to_string({LINES}[3:6], chr(10)) FROM py
      UNION ALL SELECT doc_id, piece, 'lines', t FROM ({windows_sql('other')}))"""


@query(f"{PROJECT_CTE} SELECT doc_id, CAST(piece AS bigint) AS piece, type, md5(t) AS digest FROM chunks")
def chunk_project(spark, sf_dir):
    pieces = sg.explode_pieces(sg.project_chunks(code_files(spark, sf_dir)), "chunks", "doc_id")
    return pieces.select("doc_id", "piece", "type", F.md5("text").alias("digest"))


@query(f"{PROJECT_CTE} SELECT doc_id, count(*) AS n_chunks FROM chunks GROUP BY ROLLUP (doc_id)")
def chunk_counts(spark, sf_dir):
    pieces = sg.explode_pieces(sg.project_chunks(code_files(spark, sf_dir)), "chunks", "doc_id")
    return sg.chunk_counts(pieces, "doc_id")


def lint_sql() -> str:
    trimmed, blank = f"trim(line, '{tx.BLANK_JS}')", tx.BLANK_JS_CLASS
    hits = {
        "python-print-style": f"regexp_matches({trimmed}, 'print{blank}+([^(]|$)') AND NOT contains({trimmed}, '#')",
        "python-missing-return-type": f"regexp_matches({trimmed}, 'def{blank}+\\w+\\([^)]*\\){blank}*:') AND NOT contains({trimmed}, '->')",
        "js-no-var": f"regexp_matches({trimmed}, '\\bvar{blank}+')",
        "js-strict-equality": f"contains({trimmed}, '==') AND NOT contains({trimmed}, '===')",
    }
    family = {"python": "('python')", "js": "('javascript', 'typescript')"}
    branches = [
        f"""SELECT doc_id, line_no AS line, length(line) AS width, {no} AS rule_no, '{code}' AS code, {level} AS severity,
          '{message}' AS message FROM lined WHERE language IN {family[lang]} AND {hits[code]}"""
        for no, (lang, code, level, message) in enumerate(sg.LINT_RULES)
    ]
    lined = f"lined AS (SELECT doc_id, language, unnest(range(len({LINES}))) AS line_no, unnest({LINES}) AS line FROM files)"
    return f"{FILES_CTE}, {lined}, findings AS ({' UNION ALL '.join(branches)})"


@query(f"{lint_sql()} SELECT doc_id, line, width, code, severity, message FROM findings")
def lint_lines(spark, sf_dir):
    return sg.lint_lines(files(spark, sf_dir), "doc_id").drop("rule_no")
