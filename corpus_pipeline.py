"""The corpus pipeline: language ID, near-duplicates, benchmark decontamination, mixing, token files.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; each is written as Parquet and reread as the next one's docs.
All but the last return the columns of documents; extra columns of docs, under any name, are left out. For every stage an empty table gives an
empty one, rows that repeat one another are decided alike, and texts are taken whole, however long.
"""

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from waymark import ship
from waymark.llm import decontaminate, langid, mixing, simhash, tokens
from waymark.llm.common import documents, materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def stage(make):
    """A stage that first gives the package to the session's Python workers."""

    @wraps(make)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship(spark)
        return make(spark, docs, sf_dir)

    return run_stage


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Null, empty and letterless texts go; a null doc_id or source stays; a null lang is not learned from. Of
    languages that tie, the first by name is taken."""
    return langid.keep_known(docs).select(*COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of every group of near copies: pairs of a Jaccard index of 0.8 or more on five-word shingles, chained. Texts
    without a word are one group. Rows that repeat a doc_id all stay or all go; rows without a doc_id stay."""
    return simhash.keep_one(docs).select(*COLUMNS)


@stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Null texts and items match nothing; a document that ties with a bound of edits is found and goes."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


@stage
def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' weights ask, in a global shuffle; copies share a doc_id. A null source is a source; rows that tie in
    the order of the shuffle are equal."""
    return mixing.mix(docs).select(*COLUMNS)


@stage
def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of the mixed corpus, read back from token files. A null text is the end id alone; rows without a doc_id come
    first; copies lie side by side."""
    return tokens.round_trip(docs, kept=150_000)  # the workers of this stage have served the stages before


STAGES = [
    ("language ID", language_id),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_to_weights),
    ("token-ID output", token_files),
]

#: Learned weights, connected components and alignments can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{k}")
    return docs
