"""The two Arrow UDFs that need Python's own parser.

Callers hand over NULL for rows that need no parse, and get back positions
only; the text is sliced in the JVM.
"""

from __future__ import annotations

import ast
import warnings

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFINITIONS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()),
            T.StructField("name", T.StringType()),
            T.StructField("start", T.IntegerType()),
            T.StructField("end", T.IntegerType()),
        ]
    )
)


def _tree(text: str) -> ast.AST | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            return ast.parse(text)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return None


def _definitions(text: str | None) -> list[dict] | None:
    if text is None:
        return None
    tree = _tree(text)
    if tree is None:
        return None
    kinds = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    return [
        {"kind": type(node).__name__, "name": node.name, "start": node.lineno - 1, "end": node.end_lineno}
        for node in ast.walk(tree)
        if isinstance(node, kinds)
    ]


@F.pandas_udf(T.BooleanType())
def parses(texts: pd.Series) -> pd.Series:
    """True or false by Python parse; NULL stays NULL."""
    return texts.map(lambda t: None if t is None else _tree(t) is not None).astype(object)


@F.pandas_udf(DEFINITIONS)
def definitions(texts: pd.Series) -> pd.Series:
    """Functions and classes, outermost first; NULL where the parse fails."""
    return texts.map(_definitions)
