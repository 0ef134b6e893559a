"""Vocabulary, token ids, truncation and padding."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from codeloom.functions import text as tx
from codeloom.operators.ranking import dense_ids
from codeloom.session import fits
from codeloom.sources.tables import saved

# Markers, special tokens and lengths.
START, END = "<|code|>", "<|endoftext|>"
PAD, BOS, UNK = "<|pad|>", "<|startoftext|>", "<|unk|>"
SPECIAL_TOKENS = [PAD, END, BOS, UNK]
CODE_TOKENS = ["<|code|>", "<|comment|>", "<|function|>", "<|class|>"]
TRAINING_CODE_TOKENS = CODE_TOKENS + ["<|variable|>", "<|import|>", "<|return|>", "<|if|>", "<|for|>", "<|while|>"]
MAX_LENGTH = 512

# A word (letters and digits of any script, and underscores), or any other visible character; markers stay whole.
TOKEN = rf"<\|[a-z]+\|>|{tx.WORD}+|[^\p{{L}}\p{{N}}_{tx.BLANK}]"
HOT_TOKENS = 500_000
LEFT = "array<struct<pos:int,token:string>>"


def marked(text: Column) -> Column:
    return F.concat(F.lit(START), F.coalesce(text, F.lit("")), F.lit(END))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def token_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """Occurrences of every token; counted in the map tasks before the shuffle."""
    single = tx.unnest(texts, tokens(F.col(text)), item="token")
    return single.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def extend_vocabulary(vocabulary: DataFrame, extra: Sequence[str]) -> DataFrame:
    """Adds the tokens of ``extra`` that are missing, with ids after the last one."""
    spark = vocabulary.sparkSession
    wanted = list(dict.fromkeys(extra))
    listed = spark.createDataFrame(list(enumerate(wanted)), "_place int, token string")
    present = vocabulary.filter(F.col("token").isin(wanted)).select("token")
    missing = listed.join(present, "token", "left_anti")
    # A row per missing token, placed among the missing ones: the list is fixed and short.
    places = F.transform(
        F.sort_array(F.collect_list(F.struct("_place", "token"))), lambda x, i: F.struct(i.alias("i"), x["token"].alias("token"))
    )
    last = F.coalesce(vocabulary.agg(F.max("token_id")).scalar(), F.lit(-1))
    added = missing.agg(places.alias("p")).select(F.inline("p")).select(
        "token", F.lit(0).cast("bigint").alias("n"), (last + 1 + F.col("i")).cast("bigint").alias("token_id")
    )
    return vocabulary.select("token", "n", "token_id").unionByName(added)


def build_vocabulary(texts: DataFrame, text: str = "text", extra: Sequence[str] = (*SPECIAL_TOKENS, *CODE_TOKENS)) -> DataFrame:
    """Tokens of a corpus, most frequent first, and the special tokens after them.

    The counts are used by several branches, so they are written once and the
    texts are read once.
    """
    counts = saved(token_counts(texts, text), "token-counts")
    return extend_vocabulary(saved(dense_ids(counts, "token", "n", "token_id"), "token-ids"), extra)


def _looked_up(texts: DataFrame, vocabulary: DataFrame, rare: bool) -> DataFrame:
    """``_ids`` in place of ``_tokens``: an id per token, or NULL; with ``rare`` also ``_left``, the places and tokens without one.

    The vocabulary, of bounded size, goes to the tasks; rows stay where they are.
    """
    known = vocabulary.select("token", F.col("token_id").cast("int").alias("id")).toArrow().combine_chunks()
    sent = texts.sparkSession.sparkContext.broadcast((known["token"].combine_chunks(), known["id"].combine_chunks()))
    kept = [field for field in texts.schema.fields if field.name != "_tokens"]
    fields = [T.StructField("_ids", T.ArrayType(T.IntegerType()))]
    if rare:
        fields.append(T.StructField("_left", T.DataType.fromDDL(LEFT)))
    schema = T.StructType([*kept, *fields])
    arrow, place = to_arrow_schema(schema), texts.columns.index("_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, numbers = sent.value
        for batch in batches:
            lists = batch.column(place)
            bounds = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int32)
            flat = lists.flatten()
            ids = numbers.take(pc.index_in(flat, value_set=words.cast(flat.type)))
            new = [pa.ListArray.from_arrays(pa.array(bounds), ids, type=arrow.field("_ids").type)]
            if rare:
                type_ = arrow.field("_left").type
                at = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
                where = (at - bounds[np.searchsorted(bounds, at, side="right") - 1]).astype(np.int32)
                left = pa.StructArray.from_arrays([pa.array(where), flat.take(pa.array(at)).cast(type_.value_type.field("token").type)], fields=list(type_.value_type))
                new.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(at, bounds).astype(np.int32)), left, type=type_))
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(batch.columns) if i != place] + new, schema=arrow)

    return texts.mapInArrow(run, schema)


def _with_rare(looked: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Ids of the tokens that are left; only these, and the rows that have some, are shuffled."""
    rows = saved(looked.withColumn("_row", F.monotonically_increasing_id()), "looked-up")
    whole, open_ = F.size("_left") == 0, F.size("_left") > 0
    left = tx.unnest(rows.filter(open_), F.col("_left"), "_row", item="_x").select("_row", "_x.pos", "_x.token")
    found = left.join(vocabulary.select("token", F.col("token_id").cast("int").alias("_id")), "token").groupBy("_row")
    found = found.agg(F.map_from_entries(F.collect_list(F.struct("pos", "_id"))).alias("_rare"))
    filled = F.transform("_ids", lambda x, i: F.coalesce(x, F.try_element_at("_rare", i)))
    mended = rows.filter(open_).join(found, "_row", "left").withColumn("_ids", filled)
    return rows.filter(whole).drop("_row", "_left").unionByName(mended.drop("_row", "_left", "_rare"))


def _merged(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """One row for a key that comes more than once: its tokens place by place, else the first values."""
    repeated = saved(keys.select(key).groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key")), "repeated")
    if repeated.isEmpty():
        return rows
    rows = saved(rows, "repeated-rows")
    same = F.col(key).eqNullSafe(F.col("_key"))
    placed = F.flatten(F.collect_list(F.transform("_ids", lambda x, i: F.struct(i.alias("i"), x.alias("id")))))
    others = [F.first(c).alias(c) for c in rows.columns if c not in (key, "_ids")]
    one = rows.join(repeated, same, "left_semi").groupBy(key).agg(*others, F.transform(F.sort_array(placed), lambda x: x["id"]).alias("_ids"))
    return rows.join(repeated, same, "left_anti").unionByName(one)


def encode(texts: DataFrame, vocabulary: DataFrame, key: str, text: str = "text", max_length: int = MAX_LENGTH, keep: Sequence[str] = ()) -> DataFrame:
    """Token ids of every text between its markers, cut to ``max_length``.

    Gives (key, *keep, input_ids, attention_mask, token_count, truncated). Tokens are looked up
    row by row, without a shuffle, in the ``HOT_TOKENS`` most frequent ones, which go to the tasks;
    of a larger vocabulary the tokens beyond them are joined by shuffle: each of
    them is rarer than all those before, so no join task gets a frequent one. Keys
    that come more than once, which only the keys are shuffled for to see, become one row.
    """
    found = tx.pinned(texts.select(key, *keep, F.col(text).alias("_text")), _all=tokens(marked(F.col("_text"))))
    truncated = (F.size("_all") > max_length).alias("truncated")
    cut = found.select(key, *keep, truncated, F.slice("_all", 1, max_length).alias("_tokens"))
    unknown = F.lit(vocabulary.filter(F.col("token") == UNK).agg(F.max("token_id")).first()[0]).cast("int")

    if fits(vocabulary.select("token_id"), HOT_TOKENS):
        rows = _looked_up(cut, vocabulary, rare=False)
    else:
        hot = (F.col("token_id") < HOT_TOKENS) | F.col("token").isin(SPECIAL_TOKENS + TRAINING_CODE_TOKENS)
        rows = _with_rare(_looked_up(cut, vocabulary.filter(hot), rare=True), vocabulary.filter(~hot))
    return _merged(rows, texts, key).select(
        key,
        *keep,
        F.transform("_ids", lambda x: F.coalesce(x, unknown)).alias("input_ids"),
        F.array_repeat(F.lit(1), F.size("_ids")).alias("attention_mask"),
        F.size("_ids").alias("token_count"),
        "truncated",
    )


def pad(encoded: DataFrame, pad_id: Column, key: str, max_length: int = MAX_LENGTH) -> DataFrame:
    """Only what training reads: ids and mask, both exactly ``max_length`` long."""
    room = F.greatest(F.lit(max_length) - F.size("input_ids"), F.lit(0))
    return encoded.select(
        key,
        F.concat(F.slice("input_ids", 1, max_length), F.array_repeat(pad_id.cast("int"), room)).alias("input_ids"),
        F.concat(F.slice("attention_mask", 1, max_length), F.array_repeat(F.lit(0), room)).alias("attention_mask"),
    )
