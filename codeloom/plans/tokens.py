"""Vocabulary, token id and padding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.functions.text import BLANK
from codeloom.operators import packing as pk
from codeloom.operators import tokens as tk
from codeloom.plans.registry import query
from codeloom.plans.views import documents, md5_list
from codeloom.sources.tables import saved

EXTRA = [*tk.SPECIAL_TOKENS, *tk.CODE_TOKENS]


# Blanks are those of Python's ``split``.
TOKEN_SQL = rf"<\|[a-z]+\|>|[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{BLANK}]"


def tokens_sql(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN_SQL}')"


VOCABULARY_CTE = f"""WITH counted AS (SELECT token, count(*) AS n FROM (SELECT unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY token),
    base AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, md5(token), token) - 1 AS token_id FROM counted),
    listed AS (SELECT unnest({EXTRA!r}) AS token, unnest(range({len(EXTRA)})) AS place),
    vocabulary AS (SELECT * FROM base UNION ALL
      SELECT token, 0, (SELECT max(token_id) FROM base) + row_number() OVER (ORDER BY place) FROM listed
      WHERE place IN (SELECT min(place) FROM listed GROUP BY token) AND token NOT IN (SELECT token FROM base))"""

ENCODED_CTE = f"""{VOCABULARY_CTE},
    found AS (SELECT doc_id, {tokens_sql("concat('<|code|>', text, '<|endoftext|>')")} AS t FROM documents),
    placed AS (SELECT doc_id, len(t) > 512 AS truncated, unnest(t[1:512]) AS token, unnest(range(least(len(t), 512))) AS pos FROM found),
    encoded AS (SELECT doc_id, any_value(truncated) AS truncated, count(*) AS token_count,
      list(coalesce(token_id, (SELECT token_id FROM vocabulary WHERE token = '<|unk|>')) ORDER BY pos) AS ids
      FROM placed LEFT JOIN vocabulary USING (token) GROUP BY doc_id)"""


def vocabulary(spark, sf_dir):
    return saved(tk.build_vocabulary(documents(spark, sf_dir)), "vocabulary")


def encoded(spark, sf_dir):
    words = vocabulary(spark, sf_dir)
    return tk.encode(documents(spark, sf_dir), words, "doc_id"), words


@query(f"{VOCABULARY_CTE} SELECT token, n, token_id FROM vocabulary")
def build_vocab(spark, sf_dir):
    return tk.build_vocabulary(documents(spark, sf_dir))


@query(f"{ENCODED_CTE} SELECT doc_id, token_count, truncated, md5(array_to_string(ids, ',')) AS digest FROM encoded")
def tokenize_truncate(spark, sf_dir):
    ids, _ = encoded(spark, sf_dir)
    return ids.select("doc_id", "token_count", "truncated", md5_list("input_ids").alias("digest"))


@query(
    f"""{ENCODED_CTE} SELECT doc_id, token_count AS n_real,
      md5(concat(array_to_string(ids, ','), repeat(concat(',', pad_id), 512 - token_count))) AS digest,
      md5(concat(repeat('1,', token_count - 1), '1', repeat(',0', 512 - token_count))) AS mask_digest
      FROM encoded, (SELECT token_id AS pad_id FROM vocabulary WHERE token = '<|pad|>')"""
)
def pad_to_length(spark, sf_dir):
    ids, words = encoded(spark, sf_dir)
    pad_id = words.filter(F.col("token") == tk.PAD).agg(F.max("token_id")).scalar()
    padded = tk.pad(ids, pad_id, "doc_id")
    return padded.select(
        "doc_id",
        F.size(F.filter("attention_mask", lambda m: m == 1)).alias("n_real"),
        md5_list("input_ids").alias("digest"),
        md5_list("attention_mask").alias("mask_digest"),
    )


SHARDS = 16
# Token rows of up to 1024 ids, in shards by the MD5 of their id; a separator before each but the first of a shard.
PACKED_CTE = f"""{ENCODED_CTE.replace("512", str(pk.PACKED_LENGTH))},
    dealt AS (SELECT doc_id, ids, len(ids) AS n, CAST('0x' || substr(md5(CAST(doc_id AS varchar)), 1, 4) AS int) % {SHARDS} AS shard FROM encoded),
    begun AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY doc_id) > 1 AS apart,
      sum(n + 1) OVER (PARTITION BY shard ORDER BY doc_id) - n - 1 AS base FROM dealt),
    single AS (SELECT shard, doc_id, base + i AS place, ids[CAST(i + 1 AS int)] AS id FROM (SELECT *, unnest(range(n)) AS i FROM begun)
      UNION ALL SELECT shard, NULL, base - 1, (SELECT token_id FROM vocabulary WHERE token = '<|endoftext|>') FROM begun WHERE apart),
    windows AS (SELECT shard, place // {pk.PACKED_LENGTH} AS "window", count(*) AS n_real, count(DISTINCT doc_id) AS n_pieces,
      md5(string_agg(id, ',' ORDER BY place)) AS digest FROM single GROUP BY ALL)"""


def packed(spark, sf_dir):
    words = vocabulary(spark, sf_dir)
    ids = tk.encode(documents(spark, sf_dir), words, "doc_id", max_length=pk.PACKED_LENGTH)
    separator = words.filter(F.col("token") == tk.END).agg(F.max("token_id")).first()[0]
    return pk.pack_sequences(ids, "doc_id", separator=separator, shards=SHARDS)


@query(f"""{PACKED_CTE} SELECT shard, "window", n_real, n_pieces, digest FROM windows""")
def pack_sequences(spark, sf_dir):
    return packed(spark, sf_dir).select("shard", "window", "n_real", F.size("pieces").alias("n_pieces"), md5_list("input_ids").alias("digest"))


@query(
    f"""{PACKED_CTE} SELECT count(*) AS n_windows, CAST(sum(n_real) AS bigint) AS n_ids, CAST(count(*) * {pk.PACKED_LENGTH} - sum(n_real) AS bigint) AS n_empty,
      sum(n_real) / (count(*) * {pk.PACKED_LENGTH}) AS fill FROM windows"""
)
def packing_fill(spark, sf_dir):
    return pk.packing_fill(packed(spark, sf_dir))


_STEP = pk.CHUNK_TOKENS - pk.CHUNK_OVERLAP
# Each token with the blanks before it; a chunk is a slice of these, without the blanks it starts with.
TOKEN_CHUNKS_SQL = f"""SELECT doc_id, first_token, length(lead) + length(raw) - length(t) AS start, length(lead) + length(raw) AS "end", t AS text, len(own) AS n_tokens,
      length(lead) + list_sum([length(x) for x in own[:least(3, len(own))]]) AS third_end
    FROM (SELECT *, array_to_string(ps[:first_token], '') AS lead, array_to_string(own, '') AS raw, ltrim(array_to_string(own, ''), '{BLANK}') AS t FROM (
      SELECT doc_id, ps, first_token, ps[first_token + 1:first_token + {pk.CHUNK_TOKENS}] AS own FROM (
        SELECT doc_id, ps, unnest(range(0, greatest(len(ps) - {pk.CHUNK_OVERLAP}, least(len(ps), 1)), {_STEP})) AS first_token
        FROM (SELECT doc_id, regexp_extract_all(text, '[{BLANK}]*(?:{TOKEN_SQL})') AS ps FROM documents))))"""


@query(f"""SELECT doc_id, first_token, start, "end", n_tokens, third_end, md5(text) AS digest FROM ({TOKEN_CHUNKS_SQL})""")
def chunk_tokens(spark, sf_dir):
    """Windows of 256 tokens, 50 of them shared, with their places in the text."""
    chunked = pk.chunk_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    pieces = chunked.select("doc_id", F.inline("chunks"))
    third = F.get("ends", F.least(F.size("ends"), F.lit(3)) - 1).alias("third_end")
    return pieces.select("doc_id", "first_token", "start", "end", F.size("starts").alias("n_tokens"), third, F.md5("text").alias("digest"))
