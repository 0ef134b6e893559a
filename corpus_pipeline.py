"""The corpus pipeline: five stages, each over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm import decontaminate, language, minhash, mixture, rows, token_ids
from codeloom.llm.queries import END_ID, tokenizer_path
from codeloom.sources.tables import saved


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters go: NULL, empty, blanks, digits and signs only.

    A low cosine alone rejects none, as short clean texts have one too. If no row has a language, nothing is learned, and every
    text with a letter stays. Repeated rows and rows without doc_id are judged by their text, very long texts as a whole; an
    empty table gives none. Columns stay.
    """
    model = language.prototypes(docs.filter(rows.crc_bucket("doc_id", 4) != 2))
    if not model.languages:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    found, (lang, _) = language.predict(docs, model)
    return found.filter(F.col(lang) != "und").select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, similarity 0.8.

    Texts that are NULL, empty or blank are like no other, and stay, as do rows without doc_id. Of rows with one doc_id one
    stays, the same in every run. Very long texts are compared by all their shingles; an empty table gives none. Columns stay.
    """
    return minhash.one_of_each(docs)


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go.

    NULL and empty texts hold none and stay; repeated rows and rows without doc_id are judged each by itself, very long texts as a
    whole. An empty table gives none, an empty benchmark rejects none. Columns stay.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to three times.

    Documents without words (NULL, empty, blank) have nothing to take and go. Equal rows and rows without doc_id are taken one by
    one; a NULL source is a source. Very long texts are taken whole; an empty table gives none. Columns stay.
    """
    taken = mixture.drawn(docs, docs.columns).filter("size > 0 AND times > 0")
    return taken.select("row", F.explode(F.expr("sequence(1, CAST(times AS int))"))).select("row.*")


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one line for each row, repeated ones too.

    NULL and empty texts give the end id alone; rows without doc_id are written as well. An empty table gives none.
    """
    return token_ids.token_files(docs, tokenizer_path(), END_ID)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate_benchmark),
    ("mixture", mix_sources),
    ("tokens", write_tokens),
]

#: The tokenizer, the language profiles and the signatures are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
