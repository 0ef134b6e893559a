import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from codeloom.functions import assist as fa
from codeloom.functions import text as tx


def values(spark, items, column, schema="string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(items)], f"i int, x {schema}")
    return [r.v for r in df.select("i", column(F.col("x")).alias("v")).orderBy("i").collect()]


ODD = [
    "", " ", "a", " a b ", "a\r\nb\rc\n", "x\x0by\x0cz", "\x1ca\x1db\x1ec\x1f", "a\x85b\u2028c\u2029", "\u3000é\xa0\u1680ü\u200a",
    "\n", "a\n\nb", "tab\tsep", "q\ufeff", "\u2028", "last\n\n",
]


def test_blank_rules_follow_python(spark):
    assert values(spark, ODD, lambda c: tx.strip(c)) == [s.strip() for s in ODD]
    for n in range(4):
        assert values(spark, ODD, lambda c: tx.more_words_than(c, n)) == [len(s.split()) > n for s in ODD]
    assert values(spark, ODD, tx.physical_lines) == [s.splitlines() for s in ODD]
    assert values(spark, ODD, tx.lines) == [s.split("\n") for s in ODD]
    assert values(spark, ODD, tx.line_count) == [len(s.split("\n")) for s in ODD]


def test_browser_trim(spark):
    js = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2028\u2029\u202f\u205f\u3000\ufeff"
    assert values(spark, [js + "a" + js, "\x1ca\x85"], lambda c: tx.strip(c, tx.BLANK_JS)) == ["a", "\x1ca\x85"]


def test_suffix(spark):
    paths = ["a.py", "dir.d/b", ".bashrc", "x/.hidden.TS", "a.tar.GZ", "", "d/e.js/", "no", "..c"]
    assert values(spark, paths, tx.suffix) == [PurePosixPath(p).suffix.lower() for p in paths]


@pytest.mark.parametrize(
    "path,text,language",
    [
        ("a/B.PY", "", "python"), ("a.hpp", "def import ", "cpp"), ("x.md", "def f\nimport x", "python"),
        ("", "function f() { const a }", "javascript"), ("", "public class A { static void main", "java"),
        ("", "#include <a>\nint main", "c"), ("sample_0.python", "def f(): pass", "unknown"), ("", "", "unknown"),
    ],
)
def test_detect_language(spark, path, text, language):
    df = spark.createDataFrame([(path, text)], "path string, text string")
    assert df.select(tx.detect_language(F.col("text"), F.col("path"))).first()[0] == language


PATTERNS = {
    "has_function": r"(def |function |class |public |private |protected )",
    "has_docstring": r'(""".*?"""|\'\'\'.*?\'\'\'|//.*|/\*.*?\*/)',
    "has_imports": r"(import |from |#include |require\(|use )",
    "minimal_complexity": r"[{}();]",
}
FLAG_TEXTS = [
    "", "def f", "use x", "require(", '"""a\nb"""', '""""', '"""""', '""""""', "'''a", "'''a\n'''", "/*/", "/* a\n*/", "*/ /*", "/**/",
    "a // b", ";", "public x {", "a */ b /* c */", "plain",
]


def test_quality_flags_match_the_patterns(spark):
    for name, pattern in PATTERNS.items():
        got = values(spark, FLAG_TEXTS, lambda c: tx.quality_flags(c)[name])
        assert got == [bool(re.search(pattern, t, re.M | re.S)) for t in FLAG_TEXTS], name


def test_complexity(spark):
    text = 'import os\nclass A:\n    """Doc."""\n    def f(self):  # x\n        return {}\n'
    got = spark.createDataFrame([(text,)], "t string").select(*[c.alias(n) for n, c in tx.complexity(F.col("t")).items()]).first()
    brackets = sum(c in "(){}[]" for c in text)
    assert got.complexity_score == 9 + min(brackets / 10, 5) and got.quality_rating == "excellent"
    assert (got.n_chars, got.n_lines, got.syntax_elements) == (len(text), 6, brackets)


def test_assist_rules(spark):
    context = values(spark, ["x\nclass A", "def f\n", "from a", "print(", "class def ", ""], fa.line_context)
    assert context == ["class", "other", "import", "output", "function", "other"]
    assert values(spark, ["Fix WHY", "how to improve", "better structure", "clean", "hi"], fa.chat_intent) == [
        "fix", "explain", "optimize", "refactor", "other",
    ]
    fenced = ["Sure:\n```python\nx = 1\n```\nok", "```js\ny```", " plain ", "a```", "```python```"]
    assert values(spark, fenced, lambda c: fa.clean_fenced(c, F.lit("python"))) == ["x = 1", "js\ny", "plain", "", ""]
    raw = ["```python\na\n```", " b ", "```", "``````javascript c", "d```", "```typescript```", "\ufeffe"]
    assert values(spark, raw, fa.clean_suggestion) == ["a", "b", "", "```javascript c", "d", "", "e"]
    strict = values(spark, raw, lambda c: fa.clean_suggestion(c, strict_compat=True))
    assert strict == ["python\na", "b", "", "c", "d", "typescript", "e"]
    assert values(spark, [0.85, 0.005, 0.995], fa.percent_title, "double") == [
        "Suggestion (85%)", "Suggestion (1%)", "Suggestion (100%)",
    ]
    assert values(spark, [0, 3, 9], fa.severity_label, "int") == ["❌ Error", "💡 Hint", "Unknown"]
    tips = values(spark, ["TypeError and SyntaxError", "nothing"], lambda c: fa.error_tip(c, F.lit("python")))
    assert tips == ["Look for missing colons, parentheses, or quotes.", None]
    assert values(spark, ["User: q\nAssistant: a "], lambda c: fa.strip_prompt(c, F.lit("User: q\nAssistant:"))) == ["a"]


def test_trigger(spark):
    rows = [
        ("python", 0, 1, "ab", False), ("python", 1, 2, "ab", True), ("python", 1, 4, "a # b", False), ("java", 1, 4, "a # b", True),
        ("go", 3, 9, "x // y z w", False), ("c", 1, 8, "/* a */b c", False), ("c", 1, 6, "/* a b */", True), ("ruby", 1, 5, "x = 'abc", False),
        ("ruby", 1, 7, "x = 'a' b", True), ("cobol", 1, 4, "move", False), ("php", 1, 1, " a", False),
    ]
    df = spark.createDataFrame(rows, "language string, line int, col int, t string, want boolean")
    got = df.select("want", fa.should_trigger(F.col("t"), F.col("line"), F.col("col"), F.col("language")).alias("v")).collect()
    assert [r.v for r in got] == [r.want for r in got]
