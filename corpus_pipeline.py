"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import langid, minhash, mixing, packing, pii
from quern.llm._text import free
from quern.llm.queries import pii_key
from quern.runtime import arrow_rows, row_keys, small, stage, table

#: The least response of the language classifier; a text unlike every training text has responses near 0.
LEAST_RESPONSE = 0.05
#: Texts of this similarity in shingles of five words, or more, are near duplicates here; op9_minhash has its own threshold.
NEAR_PERCENT = 80
#: A key of the rows within a stage, since doc_id may be null or repeat.
ROW = "_row"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in no known language (no letters, or unlike every language) go; a missing ``lang`` is filled in.

    Null, empty and blank texts go. The names of the two added columns are made unlike any of docs, so those pass unchanged.
    """
    pred, score = free(docs, "_lang"), free(docs, "_score")
    found = langid.identify(docs, F.lit(True), pred=pred, score=score)
    good = found.filter((F.col(pred) != langid.UNDETERMINED) & (F.col(score) >= LEAST_RESPONSE))
    return good.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest doc_id stays (nulls last); texts without words all stay."""
    row = free(docs, ROW)
    rows = row_keys(docs, row)
    found = minhash.near_rows(rows.select(F.col(row).alias("doc_id"), "text"), percent=NEAR_PERCENT)
    gone = stage(found.filter(~F.col("kept")).select(F.col("doc_id").alias(row)))
    return rows.join(small(gone), row, "left_anti").select(*docs.columns)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts are replaced; ``n_chars`` follows (null for a null text). No row goes."""
    return pii.replace_pii(docs, pii_key(spark), counts=False).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, copies and parts of documents that the mix takes; rows with equal or null doc_id are rows of their own, and
    those without words aren't taken."""
    row = free(docs, ROW)
    rows = row_keys(docs, row)
    return mixing.realize(rows, mixing.mix(rows, key=row), row).select(*docs.columns)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Lowers the session's Arrow batches, for this application's memory."""
    arrow_rows(spark)
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", deduplicate),
    ("pii", pseudonyms),
    ("mixing", mixture),
    ("packing", sequences),
]

#: SQL can't express the stages (a trained classifier, sketches, a keyed cipher, a tokenizer); tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
