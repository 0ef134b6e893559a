import ast

import pytest
from pyspark.sql import functions as F

from codeloom.operators import segments as sg


def words(letter, last):
    return " ".join(f"{letter}{i}" for i in range(last + 1))


def pieces(spark, text, column):
    df = spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("p"))
    return [tuple(r) for r in df.select(F.inline("p")).collect()]


MD = "\n\n".join(
    ["intro " + words("i", 10), "# H1", words("a", 5), words("b", 5), "## H2", words("c", 10), words("d", 2), words("e", 11)]
)


def test_markdown_gold(spark):
    got = [p[0] for p in pieces(spark, MD, sg.markdown_chunks)]
    assert got == [
        "intro " + words("i", 10),
        "# H1\n\n\n" + words("a", 5) + "\n\n" + words("b", 5),
        words("c", 10),
        words("e", 11),
    ]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("", []),
        ("# " + words("h", 10), ["# " + words("h", 10)]),
        # A stretch that begins with "#" but is no header opens its own section.
        (
            "# T\n\n#tag " + words("x", 10) + "\n\n" + words("y", 11) + "\n## Z\n" + words("z", 11),
            ["#tag " + words("x", 10) + "\n\n" + words("y", 11), words("z", 11)],
        ),
        # Adjacent headers; the last one closes the text.
        ("# A\n# " + words("b", 10) + "\n# C", ["# " + words("b", 10)]),
        (words("p", 10) + "\n\n" + words("q", 10), [words("p", 10), words("q", 10)]),
    ],
)
def test_markdown_cases(spark, text, expected):
    assert [p[0] for p in pieces(spark, text, sg.markdown_chunks)] == expected


def test_line_windows(spark):
    line = "one two three four five six"
    starts = lambda n: [p[3:] for p in pieces(spark, "\n".join([line] * n), sg.line_chunks)]
    assert starts(0) == []
    assert starts(15) == [(0, 20)]
    assert starts(16) == [(0, 20), (15, 35)]
    assert starts(20) == [(0, 20), (15, 35)]
    assert pieces(spark, "", sg.line_chunks) == []
    # A final break opens no line; other breaks count as breaks.
    got = pieces(spark, "a b c\r\nd e f\x0cg h\n", sg.line_chunks)
    assert got == [("a b c\nd e f\ng\nh", "lines", None, 0, 20)]
    # Windows reach over the whole text.
    many = pieces(spark, "\n".join(f"w{i} a b c d e" for i in range(100)), sg.line_chunks)
    assert [m[3] for m in many] == [0, 15, 30, 45, 60, 75, 90]
    assert many[-1][0].splitlines()[-1].startswith("w99 ")


def test_js_segments(spark):
    text = "\n".join(["function f(a) {", "}"] + ["x"] * 30 + ["const g = (a, b) => a; class K {", "}"])
    got = pieces(spark, text, sg.js_segments)
    assert [(g[0], g[1], g[3], g[4]) for g in got] == [("function", "f", 0, 20), ("function", "g", 32, 34), ("class", "K", 32, 34)]
    assert got[0][2] == "\n".join(text.split("\n")[:20])
    assert pieces(spark, "a\nb", sg.js_segments) == [("file", "main", "a\nb", 0, 2)]


def test_generic_segments(spark):
    text = "  static int a;\nb\npublic c\nd\n\tclass E\n"
    got = pieces(spark, text, sg.generic_segments)
    assert [(g[1], g[2], g[3], g[4]) for g in got] == [
        ("segment_0", "  static int a;\nb", 0, 2),
        ("segment_1", "public c\nd", 2, 4),
        ("segment_2", "\tclass E\n", 4, 6),
    ]
    assert pieces(spark, "", sg.generic_segments) == [("segment", "segment_0", "", 0, 1)]


PY = '''@wrap
def outer(a):
    """Doc."""
    class Inner:
        async def deep(self):
            return a
    return Inner

class Last:
    pass
'''


def test_python_segments(spark):
    df = spark.createDataFrame([(1, PY), (2, "def broken(:\n  pass"), (3, "x = 1\n"), (4, "x\x00")], "id int, text string")
    rows = sg.explode_pieces(sg.python_file_segments(df), "segments", "id").orderBy("id", "piece").collect()
    assert [(r.id, r.type, r.name, r.start_line, r.end_line) for r in rows] == [
        (1, "function", "outer", 1, 7),
        (1, "class", "Last", 8, 10),
        (1, "class", "Inner", 3, 6),
        (1, "function", "deep", 4, 6),
        (2, "file", "main", 0, 2),
        (4, "file", "main", 0, 1),
    ]
    assert rows[1].code == "class Last:\n    pass"


def test_python_chunks(spark):
    df = spark.createDataFrame([(1, PY), (2, "def broken(:\n  pass")], "id int, text string")
    rows = sg.explode_pieces(sg.python_file_chunks(df), "chunks", "id").collect()
    assert [(r.type, r.name, r.start, r.end) for r in rows] == [
        ("FunctionDef", "outer", 1, 7),
        ("ClassDef", "Inner", 3, 6),
    ]
    assert ast.parse(rows[0].text)


def test_project_dispatch(spark):
    broken = "def broken(:\n" + "a b c d e f\n" * 16
    df = spark.createDataFrame(
        [("a.md", MD), ("b.PY", PY), ("c.py", broken), ("d.go", "a b c d e f"), ("e.rs", "a b c d e f"), ("f", MD)],
        "path string, text string",
    )
    rows = sg.explode_pieces(sg.project_chunks(df), "chunks", "path").groupBy("path", "type").count().collect()
    assert {tuple(r) for r in rows} == {
        ("a.md", "doc", 4), ("b.PY", "FunctionDef", 1), ("b.PY", "ClassDef", 1), ("c.py", "lines", 2), ("d.go", "lines", 1),
    }


def test_lint(spark):
    df = spark.createDataFrame(
        [
            ("python", "  print  (x)\nprint (x)\nprint x # no\nprint x\nprinter x\ndef f(a) :\ndef f(a) -> int:"),
            ("typescript", "var a\nmyvar b\nif (a !== b) {}\nif (a == b) {}\nif (a === b) {}\nvarious"),
            ("java", "var a == b"),
        ],
        "language string, text string",
    )
    rows = sg.lint_lines(df, "language").orderBy("language", "line", "rule_no").collect()
    # "!==" holds "==" but not "===" on its own, so it is reported too.
    assert [(r.language[0], r.line, r.width, r.code, r.severity) for r in rows] == [
        ("p", 0, 12, "python-print-style", 2),
        ("p", 3, 7, "python-print-style", 2),
        ("p", 5, 10, "python-missing-return-type", 3),
        ("t", 0, 5, "js-no-var", 2),
        ("t", 2, 15, "js-strict-equality", 2),
        ("t", 3, 14, "js-strict-equality", 2),
    ]
