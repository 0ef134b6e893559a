"""Small helpers round mapInArrow."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.llm import words as w


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front as long as the table has such a column."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def with_columns(df: DataFrame, fields: str, compute: Callable[[pa.RecordBatch], Sequence], text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with new columns that ``compute`` makes from batches of texts.

    ``fields`` is a DDL list. Columns keep their names; a new one whose name is
    taken gets underscores in front. Gives the table and the new names.
    """
    added = T.StructType.fromDDL(fields)
    names = [fresh(df, field.name) for field in added]
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, f.dataType) for n, f in zip(names, added))])
    arrow = to_arrow_schema(schema)
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute(batch.column(place))
            columns = [*batch.columns, *(pa.array(m, arrow.field(n).type) for m, n in zip(made, names))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        w.release()

    return df.mapInArrow(run, schema), names


def crc_bucket(column: str, n: int):
    """crc32 of the id written as text, modulo ``n``; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n
