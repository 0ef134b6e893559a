"""Segments and chunks of code and documents.

A file is one row, so everything below works on the file's own line array and
needs no shuffle; only finished pieces are exploded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.functions.python_source import definitions
from codeloom.schemas import CHUNK, SEGMENT

_B = tx.BLANK_CLASS
_W = tx.WORD

# Patterns that open a segment.
JS_FUNCTION = rf"(?:function{_B}+({_W}+)|const{_B}+({_W}+){_B}*={_B}*(?:function|\([^)]*\){_B}*=>))"
JS_CLASS = rf"class{_B}+({_W}+)"
GENERIC_START = rf"^{_B}*(?:def|function|public|private|protected|static|class|struct|interface){_B}+"
JS_FUNCTION_LINES, JS_CLASS_LINES = 20, 30

# Files that get indexed.
CODE_SUFFIXES = [".py", ".js", ".ts", ".java", ".go", ".cpp", ".c", ".cs", ".rb"]
DOC_SUFFIXES = [".md", ".txt"]
MIN_DOC_WORDS, MIN_CODE_WORDS = 10, 5


def _segment(kind, name, parts: Column, start: Column, end: Column) -> Column:
    return F.struct(
        kind.alias("type"), name.alias("name"), tx.join_lines(parts, start, end - start).alias("code"),
        start.cast("int").alias("start_line"), end.cast("int").alias("end_line"),
    )


def _whole_file(text: Column) -> Column:
    return F.array(
        F.struct(
            F.lit("file").alias("type"), F.lit("main").alias("name"), text.alias("code"),
            F.lit(0).alias("start_line"), tx.line_count(text).cast("int").alias("end_line"),
        )
    )


def python_segments(text: Column, defs: Column) -> Column:
    """Functions and classes of parsed Python; the whole file where ``defs`` is NULL."""

    def found(parts: Column) -> Column:
        return F.transform(
            defs,
            lambda d: _segment(F.when(d["kind"] == "ClassDef", "class").otherwise("function"), d["name"], parts, d["start"], d["end"]),
        )

    return F.when(defs.isNull(), _whole_file(text)).otherwise(tx.let(tx.lines(text), found)).cast(SEGMENT)


def js_segments(text: Column) -> Column:
    """A window of lines from every function or class head; else the whole file."""

    def found(parts: Column) -> Column:
        n = F.size(parts)

        def at_line(line: Column, i: Column) -> Column:
            name = F.coalesce(
                F.nullif(F.regexp_extract(line, JS_FUNCTION, 1), F.lit("")),
                F.nullif(F.regexp_extract(line, JS_FUNCTION, 2), F.lit("")),
            )
            function = _segment(F.lit("function"), name, parts, i, F.least(n, i + JS_FUNCTION_LINES))
            klass = _segment(F.lit("class"), F.regexp_extract(line, JS_CLASS, 1), parts, i, F.least(n, i + JS_CLASS_LINES))
            both = F.array(F.when(line.rlike(JS_FUNCTION), function), F.when(line.rlike(JS_CLASS), klass))
            return F.filter(both, lambda s: s.isNotNull())

        return F.flatten(F.transform(parts, at_line))

    return tx.let(
        tx.let(tx.lines(text), found), lambda f: F.when(F.size(f) > 0, f).otherwise(_whole_file(text))
    ).cast(SEGMENT)


def generic_segments(text: Column) -> Column:
    """Cuts before every definition-like line but the first line of the file."""

    def cut(parts: Column) -> Column:
        starts = F.filter(
            F.transform(parts, lambda line, i: F.when((i > 0) & line.rlike(GENERIC_START), i)), lambda i: i.isNotNull()
        )
        edges = F.concat(F.array(F.lit(0)), starts, F.array(F.size(parts)))
        return tx.let(
            edges,
            lambda e: F.transform(
                F.slice(e, F.lit(1), F.size(e) - 1),
                lambda start, j: _segment(
                    F.lit("segment"), F.concat(F.lit("segment_"), j.cast("string")), parts, start, F.get(e, j + 1)
                ),
            ),
        )

    return tx.let(tx.lines(text), cut).cast(SEGMENT)


def _python_only(text: Column, condition: Column) -> Column:
    return definitions(F.when(condition, text))


def code_segments(files: DataFrame) -> DataFrame:
    """Segments by language: parsed Python, JS/TS line windows, generic cuts."""
    text, language = F.col("text"), F.col("language")
    parsed = files.withColumn("_defs", _python_only(text, language == "python"))
    segments = (
        F.when(language == "python", python_segments(text, F.col("_defs")))
        .when(language.isin("javascript", "typescript"), js_segments(text))
        .otherwise(generic_segments(text))
    )
    return parsed.withColumn("segments", segments).drop("_defs")


def python_file_segments(files: DataFrame) -> DataFrame:
    parsed = files.withColumn("_defs", _python_only(F.col("text"), F.lit(True)))
    return parsed.withColumn("segments", python_segments(F.col("text"), F.col("_defs"))).drop("_defs")


def explode_pieces(df: DataFrame, pieces: str, *keys: str) -> DataFrame:
    """One row per piece with its 0-based place in the file."""
    return tx.unnest(df, F.col(pieces), *keys, pos="piece", item="_p").select(*keys, "piece", "_p.*")


def _chunk(text: Column, kind: Column, name: Column, start: Column, end: Column) -> Column:
    return F.struct(
        text.alias("text"), kind.alias("type"), name.cast("string").alias("name"),
        start.cast("int").alias("start"), end.cast("int").alias("end"),
    )


def markdown_chunks(text: Column) -> Column:
    """Sections at header lines; only the last section is cut at blank lines.

    A stretch between headers that itself begins with ``#`` opens a section of
    its own. Pieces of ten words or fewer are dropped.
    """

    def sections(parts: Column) -> Column:
        n = F.size(parts)
        heads = F.filter(F.transform(parts, lambda line, i: F.when(line.rlike("^#+ "), i)), lambda i: i.isNotNull())

        def stretch(start: Column, end: Column, before: str) -> Column:
            """Text between two headers, with the line breaks that border it."""
            after = F.when(end < n, "\n").otherwise("")
            body = F.concat(F.lit(before), tx.join_lines(parts, start, end - start), after)
            return F.when(start < end, body).otherwise(F.when(end < n, before).otherwise(""))

        def opened(body: Column) -> Column:
            return F.startswith(tx.strip(body), F.lit("#"))

        def section(head: Column, end: Column) -> Column:
            title = F.concat(tx.strip(F.get(parts, head)), F.lit("\n"))
            return tx.let(
                stretch(head + 1, end, "\n"),
                lambda body: F.when(opened(body), F.array(title, F.concat(tx.strip(body), F.lit("\n")))).otherwise(
                    F.array(F.concat(title, body))
                ),
            )

        def all_sections(h: Column) -> Column:
            lead = tx.let(
                stretch(F.lit(0), F.coalesce(F.get(h, F.lit(0)), n), ""),
                lambda body: F.when(opened(body), F.concat(tx.strip(body), F.lit("\n"))).otherwise(body),
            )
            rest = F.transform(h, lambda head, j: section(head, F.coalesce(F.get(h, j + 1), n)))
            return F.concat(F.array(lead), F.flatten(rest))

        return tx.let(heads, all_sections)

    def pieces(found: Column) -> Column:
        return F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.split(F.element_at(found, -1), "\n\n", -1))

    cut = F.transform(tx.let(tx.let(tx.lines(text), sections), pieces), lambda p: tx.strip(p))
    long = F.filter(cut, lambda p: tx.more_words_than(p, MIN_DOC_WORDS))
    null = F.lit(None)
    return F.transform(long, lambda p: _chunk(p, F.lit("doc"), null, null, null)).cast(CHUNK)


def line_chunks(text: Column, window: int = 20, overlap: int = 5) -> Column:
    """Windows of lines, ``window - overlap`` apart; more than five words each.

    ``end`` is the nominal end of the window, also past the end of the file.
    """
    step = window - overlap

    def windows(parts: Column) -> Column:
        n = F.size(parts)
        starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(
            starts, lambda i: _chunk(tx.join_lines(parts, i, F.lit(window)), F.lit("lines"), F.lit(None), i, i + window)
        )

    chunks = tx.let(tx.physical_lines(text), windows)
    return F.filter(chunks, lambda c: tx.more_words_than(c["text"], MIN_CODE_WORDS)).cast(CHUNK)


def python_chunks(text: Column, defs: Column) -> Column:
    """Functions and classes of parsed Python with more than five words."""

    def cut(parts: Column) -> Column:
        return F.transform(
            defs,
            lambda d: _chunk(
                tx.join_lines(parts, d["start"], d["end"] - d["start"]), d["kind"], d["name"], d["start"], d["end"]
            ),
        )

    chunks = F.filter(tx.let(tx.physical_lines(text), cut), lambda c: tx.more_words_than(c["text"], MIN_CODE_WORDS))
    return F.coalesce(chunks, F.array()).cast(CHUNK)


def python_file_chunks(files: DataFrame) -> DataFrame:
    parsed = files.withColumn("_defs", _python_only(F.col("text"), F.lit(True)))
    return parsed.withColumn("chunks", python_chunks(F.col("text"), F.col("_defs"))).drop("_defs")


def project_chunks(files: DataFrame) -> DataFrame:
    """Chunks of a project tree (path, text): documents, Python, other code.

    Python without usable definitions falls back to line windows. Files with
    other suffixes give no chunks.
    """
    text, ext = F.col("text"), tx.suffix(F.col("path"))
    known = files.withColumn("_ext", ext).filter(F.col("_ext").isin(CODE_SUFFIXES + DOC_SUFFIXES))
    parsed = known.withColumn("_defs", _python_only(text, F.col("_ext") == ".py"))
    python = tx.let(
        python_chunks(text, F.col("_defs")), lambda own: F.when(F.size(own) > 0, own).otherwise(line_chunks(text))
    )
    chunks = (
        F.when(F.col("_ext").isin(DOC_SUFFIXES), markdown_chunks(text))
        .when(F.col("_ext") == ".py", python)
        .otherwise(line_chunks(text))
    )
    return parsed.withColumn("chunks", chunks).drop("_ext", "_defs")


def chunk_counts(chunks: DataFrame, file: str) -> DataFrame:
    """Chunks per file, and in total where the file is NULL."""
    return chunks.rollup(file).agg(F.count(F.lit(1)).alias("n_chunks"))


# Rule, level and message of each line check.
LINT_RULES = [
    ("python", "python-print-style", 2, "Consider using print() with parentheses for Python 3 compatibility"),
    ("python", "python-missing-return-type", 3, "Consider adding a return type hint for better code documentation"),
    ("js", "js-no-var", 2, 'Consider using "let" or "const" instead of "var"'),
    ("js", "js-strict-equality", 2, 'Consider using "===" for strict equality comparison'),
]
_BJ = tx.BLANK_JS_CLASS


def _lint_hits(line: Column) -> dict[str, Column]:
    trimmed = tx.strip(line, tx.BLANK_JS)
    return {
        "python-print-style": trimmed.rlike(rf"print{_BJ}+([^(]|\z)") & ~trimmed.contains("#"),
        "python-missing-return-type": trimmed.rlike(rf"def{_BJ}+[0-9A-Za-z_]+\([^)]*\){_BJ}*:") & ~trimmed.contains("->"),
        "js-no-var": trimmed.rlike(rf"(^|[^0-9A-Za-z_])var{_BJ}+"),
        "js-strict-equality": trimmed.contains("==") & ~trimmed.contains("==="),
    }


def lint_lines(files: DataFrame, *keys: str) -> DataFrame:
    """One row per finding: line, width, level (0 error .. 3 hint), message, rule."""
    language, line = F.col("language"), F.col("_line")
    family = {"python": language == "python", "js": language.isin("javascript", "typescript")}
    checked = files.filter(family["python"] | family["js"])
    per_line = tx.unnest(checked, tx.lines(F.col("text")), *keys, "language", pos="line", item="_line")
    hits = _lint_hits(line)
    findings = F.array(
        *[
            F.when(
                family[lang] & hits[code],
                F.struct(
                    F.lit(i).alias("rule_no"), F.lit(code).alias("code"),
                    F.lit(level).alias("severity"), F.lit(message).alias("message"),
                ),
            )
            for i, (lang, code, level, message) in enumerate(LINT_RULES)
        ]
    )
    width = F.length(line).alias("width")
    found = tx.unnest(per_line, findings, *keys, "line", width, item="_found").filter(F.col("_found").isNotNull())
    return found.select(*keys, "line", "width", "_found.*")
