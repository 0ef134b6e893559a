"""Column expressions over whole texts. All of them run in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The characters str.strip()/str.split() and the browser's
# String.trim() treat as blank, and the breaks str.splitlines() knows.
_BLANK_COMMON = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
BLANK = _BLANK_COMMON + "\x1c\x1d\x1e\x1f\x85"
BLANK_JS = _BLANK_COMMON + "\ufeff"
BLANK_CLASS = f"[{BLANK}]"
BLANK_JS_CLASS = f"[{BLANK_JS}]"
RARE_BREAKS = ["\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
LINE_BREAK = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
WORD = r"[\p{L}\p{N}_]"

# File suffixes per language.
LANGUAGE_SUFFIXES = {
    "python": [".py"],
    "javascript": [".js", ".jsx"],
    "typescript": [".ts", ".tsx"],
    "java": [".java"],
    "cpp": [".cpp", ".cxx", ".cc", ".hpp"],
    "c": [".c", ".h"],
    "go": [".go"],
    "rust": [".rs"],
    "php": [".php"],
    "ruby": [".rb"],
}

# What the quality flags look for.
FUNCTION_WORDS = ["def ", "function ", "class ", "public ", "private ", "protected "]
IMPORT_WORDS = ["import ", "from ", "#include ", "require(", "use "]
SYNTAX_MARKS = ["{", "}", "(", ")", ";"]
QUALITY_FLAGS = ["has_function", "has_docstring", "has_imports", "minimal_complexity"]

# Words a file of the language must hold at least one of.
LANGUAGE_KEYWORDS = {
    "python": ["def ", "class ", "import ", "if __name__"],
    "javascript": ["function", "const ", "var ", "let "],
}

# Corpus limits.
MIN_LINES, MAX_LINES, MAX_CHARS = 5, 512, 1024 * 1024
MIN_QUALITY = 0.3
MIN_COMPLEXITY = 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also inside lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds or replaces columns, each computed once per row.

    Spark moves conditions below a projection by repeating its expressions in
    them; a generator of one row is not repeated.
    """
    values = F.struct(*[column.alias(name) for name, column in columns.items()])
    return df.select(*[name for name in df.columns if name not in columns], F.inline(F.array(values)))


@contextmanager
def last_key_counts(spark: SparkSession) -> Iterator[None]:
    """In here, JSON objects that repeat a key are parsed with the key's last value, as Python's reader does.

    Spark fixes the rule when an expression is resolved, so the plan keeps it.
    """
    name = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def unnest(df: DataFrame, array: Column, *keep: Column | str, pos: str = "pos", item: str = "item") -> DataFrame:
    """One row per array item with its 0-based place; empty arrays give none.

    A plain explode makes Spark test the size of the array first, which means
    computing the array twice; the outer form with a test on the place does not.
    """
    rows = df.select(*keep, F.posexplode_outer(array).alias(pos, item))
    return rows.filter(F.col(pos).isNotNull())


def contains_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def strip(text: Column, blanks: str = BLANK) -> Column:
    return F.btrim(text, F.lit(blanks))


def more_words_than(text: Column, n: int) -> Column:
    """Whether the text has more than ``n`` blank-separated words; looks no further."""
    blank, word = f"{BLANK_CLASS}", f"[^{BLANK}]"
    return text.rlike(rf"\A{blank}*+(?:{word}++{blank}++){{{n}}}{word}")


def lines(text: Column) -> Column:
    """Lines as ``text.split("\\n")`` gives them."""
    return F.split(text, "\n", -1)


def physical_lines(text: Column) -> Column:
    """Lines as ``splitlines`` gives them: every break counts, no empty last line."""
    parts = F.when(contains_any(text, RARE_BREAKS), F.split(text, LINE_BREAK, -1)).otherwise(lines(text))
    return let(
        parts, lambda p: F.when(F.element_at(p, -1) == "", F.slice(p, F.lit(1), F.size(p) - 1)).otherwise(p)
    )


def join_lines(parts: Column, start: Column, count: Column) -> Column:
    return F.array_join(F.slice(parts, start + 1, count), "\n")


def code_text(content: Column, code: Column) -> Column:
    """First of the two fields that is neither missing nor empty."""
    return F.coalesce(F.nullif(content, F.lit("")), F.nullif(code, F.lit("")))


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"[^/]([.][^./]+)/*\z", 1))


def detect_language(text: Column, path: Column) -> Column:
    """Language by file suffix; without a known suffix, by telling substrings."""
    known = F.create_map(*[F.lit(x) for name, exts in LANGUAGE_SUFFIXES.items() for ext in exts for x in (ext, name)])
    by_suffix = F.try_element_at(known, suffix(path))
    by_content = (
        F.when(text.contains("def ") & text.contains("import "), "python")
        .when(text.contains("function ") & contains_any(text, ["var ", "const "]), "javascript")
        .when(text.contains("public class ") & text.contains("static void main"), "java")
        .when(text.contains("#include") & text.contains("int main"), "c")
        .otherwise("unknown")
    )
    return F.coalesce(by_suffix, by_content)


def line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def avg_line_length(text: Column) -> Column:
    return F.length(text) / line_count(text)


def _twice(text: Column, mark: str) -> Column:
    """Two separate occurrences of the mark."""
    left = F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))
    return text.contains(mark) & (left >= 2 * len(mark))


def quality_flags(text: Column) -> dict[str, Column]:
    """Flags by substring search, which is several times faster than one pattern.

    A docstring is a closed triple-quoted text, a closed block comment, or
    anything after two slashes.
    """
    opened = F.locate("/*", text)
    block = (opened > 0) & (F.position(F.lit("*/"), text, opened + 2) > 0)
    return {
        "has_function": contains_any(text, FUNCTION_WORDS),
        "has_docstring": text.contains("//") | block | _twice(text, '"""') | _twice(text, "'''"),
        "has_imports": contains_any(text, IMPORT_WORDS),
        "minimal_complexity": contains_any(text, SYNTAX_MARKS),
    }


def flag_points(text: Column) -> Column:
    """How many of the quality patterns occur."""
    return reduce(lambda a, b: a + b, [flag.cast("int") for flag in quality_flags(text).values()])


def may_be_python(text: Column) -> Column:
    """Only texts with a definition keyword are ever parsed."""
    return contains_any(text, ["def ", "class "])


def quality_points(flags: Column, valid: Column) -> Column:
    return flags + F.when(valid, 2).otherwise(0)


def quality_score(points: Column) -> Column:
    return points / F.lit(float(len(QUALITY_FLAGS) + 2))


def language_keywords_ok(text: Column, language: Column) -> Column:
    ok = F.lit(True)
    for name, words in LANGUAGE_KEYWORDS.items():
        ok = F.when(language == name, contains_any(text, words)).otherwise(ok)
    return ok


def complexity(text: Column) -> dict[str, Column]:
    """Shape metrics of one generated code text, with a score and a rating."""
    brackets = F.length(text) - F.length(F.translate(text, "(){}[]", ""))
    parts = {
        "n_chars": F.length(text),
        "n_lines": line_count(text),
        "has_functions": text.contains("def "),
        "has_classes": text.contains("class "),
        "has_imports": contains_any(text, ["import ", "from "]),
        "has_docstrings": contains_any(text, ['"""', "'''"]),
        "has_comments": text.contains("#"),
        "syntax_elements": brackets,
    }
    weights = {"has_functions": 2, "has_classes": 3, "has_imports": 1, "has_docstrings": 2, "has_comments": 1}
    score = reduce(lambda a, b: a + b, [parts[name].cast("int") * w for name, w in weights.items()])
    score = score + F.least(brackets / F.lit(10.0), F.lit(5.0))
    rating = F.when(score >= 8, "excellent").when(score >= 5, "good").when(score >= 3, "fair").otherwise("basic")
    return {**parts, "complexity_score": score, "quality_rating": rating}
