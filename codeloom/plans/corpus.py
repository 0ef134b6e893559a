"""Corpus queries: text picking, language, quality, filters, caps, splits, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.operators import corpus, ranking
from codeloom.plans.registry import query
from codeloom.plans.views import CODE_FILES_SQL, code_files, table

LANGUAGE_SQL = """coalesce(
    CASE lower(regexp_extract(path, '[^/]([.][^./]+)/*\\z', 1))
      WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' WHEN '.jsx' THEN 'javascript'
      WHEN '.ts' THEN 'typescript' WHEN '.tsx' THEN 'typescript' WHEN '.java' THEN 'java'
      WHEN '.cpp' THEN 'cpp' WHEN '.cxx' THEN 'cpp' WHEN '.cc' THEN 'cpp' WHEN '.hpp' THEN 'cpp'
      WHEN '.c' THEN 'c' WHEN '.h' THEN 'c' WHEN '.go' THEN 'go' WHEN '.rs' THEN 'rust'
      WHEN '.php' THEN 'php' WHEN '.rb' THEN 'ruby' END,
    CASE WHEN contains(text, 'def ') AND contains(text, 'import ') THEN 'python'
      WHEN contains(text, 'function ') AND (contains(text, 'var ') OR contains(text, 'const ')) THEN 'javascript'
      WHEN contains(text, 'public class ') AND contains(text, 'static void main') THEN 'java'
      WHEN contains(text, '#include') AND contains(text, 'int main') THEN 'c'
      ELSE 'unknown' END)"""

FILES_CTE = f"WITH files AS (SELECT *, {LANGUAGE_SQL} AS language FROM ({CODE_FILES_SQL}))"

N_LINES_SQL = "len(string_split(text, chr(10)))"

FLAGS_SQL = {
    "has_function": r"regexp_matches(text, '(def |function |class |public |private |protected )')",
    "has_docstring": r"""regexp_matches(text, '(\"\"\"[\s\S]*?\"\"\"|''''''[\s\S]*?''''''|//|/\*[\s\S]*?\*/)')""",
    "has_imports": r"regexp_matches(text, '(import |from |#include |require\(|use )')",
    "minimal_complexity": r"regexp_matches(text, '[{}();]')",
}
POINTS_SQL = " + ".join(f"CAST({flag} AS int)" for flag in FLAGS_SQL.values())

# What the parser must say follows from the template a file was made from.
VALID_SQL = """CASE WHEN contains(text, 'def ') OR contains(text, 'class ') THEN doc_id % 8 = 0 END"""

KEYWORDS_SQL = """CASE language
    WHEN 'python' THEN contains(text, 'def ') OR contains(text, 'class ') OR contains(text, 'import ') OR contains(text, 'if __name__')
    WHEN 'javascript' THEN contains(text, 'function') OR contains(text, 'const ') OR contains(text, 'var ') OR contains(text, 'let ')
    ELSE true END"""

FILTER_SQL = f"""{N_LINES_SQL} BETWEEN 5 AND 512 AND length(text) <= 1048576
    AND {POINTS_SQL} + CASE WHEN {VALID_SQL} THEN 2 ELSE 0 END >= 2 AND {KEYWORDS_SQL}"""


def files(spark, sf_dir) -> DataFrame:
    return corpus.with_language(code_files(spark, sf_dir))


@query(
    f"""{FILES_CTE} SELECT language, count(*) AS n_files, CAST(sum({N_LINES_SQL}) AS bigint) AS n_lines,
      CAST(sum(length(text)) AS bigint) AS n_chars FROM files WHERE {FILTER_SQL} GROUP BY language"""
)
def curate_corpus(spark, sf_dir):
    """Flagship: detect, score and filter the corpus, then size up each language."""
    kept = corpus.filter_code(files(spark, sf_dir))
    return kept.groupBy("language").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.sum(tx.line_count(F.col("text"))).cast("bigint").alias("n_lines"),
        F.sum(F.length("text")).cast("bigint").alias("n_chars"),
    )


@query(f"{FILES_CTE} SELECT doc_id, language FROM files WHERE {FILTER_SQL}")
def filter_code(spark, sf_dir):
    return corpus.filter_code(files(spark, sf_dir)).select("doc_id", "language")


@query(
    """SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT doc_id, coalesce(
        nullif(CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END, ''),
        nullif(CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 < 2 THEN text END, '')) AS t FROM documents) WHERE t IS NOT NULL"""
)
def pick_code_text(spark, sf_dir):
    records = table(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE text END AS content",
        "CASE WHEN doc_id % 5 = 0 THEN '' WHEN doc_id % 4 < 2 THEN text END AS code",
    )
    return corpus.with_code_text(records).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


@query(f"{FILES_CTE} SELECT doc_id, language FROM files")
def detect_language(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", "language")


@query(
    f"""SELECT doc_id, {N_LINES_SQL} AS line_count, length(text) AS char_count,
        length(text) / {N_LINES_SQL} AS avg_line_length FROM documents"""
)
def size_metrics(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        tx.line_count(text).cast("bigint").alias("line_count"),
        F.length(text).cast("bigint").alias("char_count"),
        tx.avg_line_length(text).alias("avg_line_length"),
    )


@query(f"{FILES_CTE} SELECT doc_id, {', '.join(f'{sql} AS {name}' for name, sql in FLAGS_SQL.items())} FROM files")
def quality_flags(spark, sf_dir):
    flags = tx.quality_flags(F.col("text"))
    return code_files(spark, sf_dir).select("doc_id", *[flag.alias(name) for name, flag in flags.items()])


@query(
    f"""{FILES_CTE}, scored AS (SELECT doc_id, {POINTS_SQL} + CASE WHEN {VALID_SQL} THEN 2 ELSE 0 END AS points FROM files)
      SELECT doc_id, points, points / 6.0::double AS quality_score FROM scored"""
)
def quality_score(spark, sf_dir):
    return corpus.with_quality(code_files(spark, sf_dir)).select("doc_id", "points", "quality_score")


SCORED_CTE = f"""{FILES_CTE}, parts AS (SELECT doc_id, length(text) AS n_chars, {N_LINES_SQL} AS n_lines,
        contains(text, 'def ') AS f, contains(text, 'class ') AS c,
        contains(text, 'import ') OR contains(text, 'from ') AS i,
        contains(text, '\"\"\"') OR contains(text, '''''''') AS d, contains(text, '#') AS h,
        length(regexp_replace(text, '[^(){{}}\\[\\]]', '', 'g')) AS n FROM files),
      scored AS (SELECT *, 2 * f::int + 3 * c::int + i::int + 2 * d::int + h::int + least(n::double / 10, 5) AS s FROM parts)"""


@query(
    f"""{SCORED_CTE} SELECT doc_id, n_chars, n_lines, n AS syntax_elements, s AS complexity_score,
        CASE WHEN s >= 8 THEN 'excellent' WHEN s >= 5 THEN 'good' WHEN s >= 3 THEN 'fair' ELSE 'basic' END AS quality_rating
      FROM scored"""
)
def complexity_rating(spark, sf_dir):
    parts = tx.complexity(F.col("text"))
    names = ["n_chars", "n_lines", "syntax_elements", "complexity_score", "quality_rating"]
    return code_files(spark, sf_dir).select("doc_id", *[parts[name].alias(name) for name in names])


@query(f"{SCORED_CTE} SELECT doc_id FROM scored WHERE s >= 2")
def filter_complexity(spark, sf_dir):
    """Code files that reach the declared least complexity score."""
    return corpus.filter_complexity(code_files(spark, sf_dir)).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {N_LINES_SQL} BETWEEN 5 AND 512 AND length(text) <= 1048576")
def filter_length(spark, sf_dir):
    return table(spark, sf_dir, "documents").filter(corpus.length_ok(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id FROM documents WHERE {N_LINES_SQL} BETWEEN 5 AND 200 AND length(text) BETWEEN 100 AND 4096")
def filter_length_bounds(spark, sf_dir):
    """The same filter with the narrower bounds of the training set-up."""
    ok = corpus.length_ok(F.col("text"), min_lines=5, max_lines=200, min_chars=100, max_chars=4096)
    return table(spark, sf_dir, "documents").filter(ok).select("doc_id")


@query(f"{FILES_CTE} SELECT doc_id FROM files WHERE {POINTS_SQL} + CASE WHEN {VALID_SQL} THEN 2 ELSE 0 END >= 2")
def filter_quality(spark, sf_dir):
    return corpus.filter_quality(code_files(spark, sf_dir)).select("doc_id")


@query(f"{FILES_CTE} SELECT doc_id, language FROM files WHERE {KEYWORDS_SQL}")
def filter_language_keywords(spark, sf_dir):
    kept = files(spark, sf_dir).filter(tx.language_keywords_ok(F.col("text"), F.col("language")))
    return kept.select("doc_id", "language")


@query(
    f"""SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS place
        FROM documents WHERE length(text) > 100 AND length(text) < 1048576 AND {N_LINES_SQL} >= 5) WHERE place <= 50"""
)
def ingest_capped_per_lang(spark, sf_dir):
    return corpus.capped_ingest(table(spark, sf_dir, "documents"), "lang", F.col("doc_id"), cap=50).select("doc_id", "lang")


@query("SELECT source, concat(source, '_', lang, '.jsonl') AS file, count(*) AS n_rows FROM documents GROUP BY ALL")
def manifest_by_source(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return corpus.manifest(documents, "source", F.concat("source", F.lit("_"), "lang", F.lit(".jsonl")))


SPLIT_SQL = """SELECT doc_id, CASE WHEN place <= floor(n * 0.8::double) THEN 'train'
      WHEN place <= floor(n * 0.8::double) + floor(n * 0.1::double) THEN 'validation' ELSE 'test' END AS split
    FROM (SELECT doc_id, row_number() OVER (ORDER BY md5(concat('42:', doc_id)), doc_id) AS place,
      count(*) OVER () AS n FROM documents)"""


@query(SPLIT_SQL)
def train_val_test_split(spark, sf_dir):
    return ranking.ratio_split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query(
    """SELECT doc_id, CASE WHEN b < 8 THEN 'train' WHEN b < 9 THEN 'validation' ELSE 'test' END AS split
      FROM (SELECT doc_id, CAST('0x' || substr(md5(concat('42:', doc_id)), 1, 8) AS bigint) % 10 AS b FROM documents)"""
)
def hash_bucket_split(spark, sf_dir):
    return ranking.hash_split(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "split")


@query(f"SELECT split, count(*) AS n_rows FROM ({SPLIT_SQL}) GROUP BY split")
def split_counts(spark, sf_dir):
    return corpus.split_counts(ranking.ratio_split(table(spark, sf_dir, "documents"), "doc_id"))


@query("SELECT lang, source, count(*) AS n_rows FROM documents GROUP BY ROLLUP (lang, source)")
def counts_by_lang(spark, sf_dir):
    return corpus.counts_by(table(spark, sf_dir, "documents"), "lang", "source")


@query(
    f"""WITH read AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS line FROM documents)
        WHERE line <= 40 AND {N_LINES_SQL} >= 5),
      placed AS (SELECT *, row_number() OVER (ORDER BY source, doc_id) AS place FROM read)
      SELECT doc_id, source FROM placed WHERE place <= 40"""
)
def limit_per_source(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    enough_lines = tx.line_count(F.col("text")) >= tx.MIN_LINES
    return corpus.limited_per_source(documents, "source", "doc_id", 40, enough_lines).select("doc_id", "source")


@query(
    """SELECT CAST(doc_id AS varchar) AS id, lang, NULL AS url, length(text) AS n_chars FROM documents
      UNION ALL SELECT CAST(page_id AS varchar), NULL, url, length(html) FROM pages
      UNION ALL SELECT CAST(item_id AS varchar), NULL, NULL, length(text) FROM benchmark"""
)
def union_sources(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").selectExpr("CAST(doc_id AS string) AS id", "lang", "text")
    pages = table(spark, sf_dir, "pages").selectExpr("CAST(page_id AS string) AS id", "url", "html AS text")
    benchmark = table(spark, sf_dir, "benchmark").selectExpr("CAST(item_id AS string) AS id", "text")
    return corpus.union_sources(documents, pages, benchmark).select("id", "lang", "url", F.length("text").alias("n_chars"))


@query(
    """SELECT doc_id, quality, toxic, r.range AS copy, 'train' AS split FROM labels, range(1, 13) r
      UNION ALL (SELECT doc_id, quality, toxic, 1, 'validation' FROM labels ORDER BY doc_id LIMIT 3)"""
)
def oversample_rows(spark, sf_dir):
    return corpus.oversample(table(spark, sf_dir, "labels"), F.col("doc_id"))
