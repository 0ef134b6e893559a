"""Lines that many documents share are dropped; DataFrame functions only.

Lines are exploded, normalised and hashed to 128 bits, distinct documents are
counted per hash, and the lines that reach the threshold are dropped; a document is
put together again from the positions that are left.

Each row is a document: repeated rows count each, whatever their doc_id, NULL
included. A NULL or empty text is one empty line; lines whose key is shorter
than ``min_chars`` always stay, so with 1 or more an empty line does. A text that
loses no line comes out byte for byte, one that loses all is empty. A very long
text is one row of arrays, in linear work. An empty table gives an empty one. New
columns whose name is taken get underscores in front; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions import text as tx
from codeloom.llm import rows
from codeloom.sources.tables import saved

BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys with at least this part of all lines to be dropped are broadcast; there can be no more of them than this.
HOT_KEYS = 50_000


def line_key(line: Column) -> Column:
    """The line without blanks at both ends, A-Z in lower case; other letters as they are."""
    bare = F.btrim(line, F.lit(BLANKS))
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, UPPER.lower()))


def _hashed(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(1), key).alias("g")]


def common_lines(docs: DataFrame, min_docs: int, min_chars: int = 1, text: str = "text") -> DataFrame:
    """h, g (the hash of a line's key) and n, the number of its documents, if at least ``min_docs``."""
    keys = F.array_distinct(F.transform(tx.lines(F.coalesce(text, F.lit(""))), line_key))
    found = tx.unnest(docs, keys, item="key").filter(F.length("key") >= min_chars)
    return found.select(*_hashed("key")).groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_docs)


def without_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text") -> tuple[DataFrame, list[str]]:
    """The rows with n_lines, n_dropped and kept, the text of the lines left; and the names of these columns.

    A line that very many documents hold is met by broadcast: of the keys that
    hold 1/``HOT_KEYS`` of the lines to be dropped there are ``HOT_KEYS`` at most. The
    other lines are joined by key, where none is frequent; if the table of keys is
    small, Spark broadcasts it too. Only positions of dropped lines are
    grouped, each document's own, and come back to it by a row number stored with the rows.
    """
    names = [rows.fresh(docs, name) for name in ("n_lines", "n_dropped", "kept")]
    id_, gone_, lines_ = (rows.fresh(docs, name) for name in ("_row", "_gone", "_lines"))
    numbered = saved(docs.withColumn(id_, F.monotonically_increasing_id()), "numbered-documents")
    common = saved(common_lines(numbered, min_docs, min_chars, text), "common-lines")
    total = common.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    is_hot = F.col("n") * HOT_KEYS >= total
    hot = F.broadcast(common.filter(is_hot).select("h", "g", F.lit(True).alias("_hot")))
    rest = common.filter(~is_hot).select("h", "g", F.lit(True).alias("_rest"))

    parts = tx.unnest(numbered, tx.lines(F.coalesce(text, F.lit(""))), F.col(id_).alias("_id"), item="line")
    parts = parts.select("_id", "pos", line_key(F.col("line")).alias("key")).filter(F.length("key") >= min_chars)
    marked = parts.select("_id", "pos", *_hashed("key")).join(hot, ["h", "g"], "left")
    # A line that is already settled takes a key of its own, so that no key is frequent in the second join.
    marked = marked.withColumn("h", F.when(F.col("_hot"), F.xxhash64("_id", "pos")).otherwise(F.col("h")))
    marked = marked.join(rest, ["h", "g"], "left").filter(F.col("_hot") | F.col("_rest"))
    gone = marked.groupBy(F.col("_id").alias(id_)).agg(F.collect_list("pos").alias(gone_))

    lines = numbered.join(gone, id_, "left").withColumn(lines_, tx.lines(F.coalesce(text, F.lit(""))))
    kept_places = F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone_))
    kept = F.array_join(F.transform(kept_places, lambda i: F.get(lines_, i)), "\n")
    n_dropped = F.when(F.col(gone_).isNull(), 0).otherwise(F.size(gone_))
    kept = F.when(F.col(gone_).isNull(), F.coalesce(text, F.lit(""))).otherwise(kept)
    made = tx.pinned(lines, **{names[0]: F.size(lines_).cast("bigint"), names[1]: n_dropped.cast("bigint"), names[2]: kept})
    return made.select(*docs.columns, *names), names
