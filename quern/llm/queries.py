"""The queries op1 to op10 and the pipeline: thin wrappers that apply each operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import chat, hmm, langid, minhash, mixing, neighbours, packing, pii, spotsigs, toxicity
from quern.runtime import arrow_rows, table

Query = Callable[[SparkSession, str], DataFrame]


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, mod n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = langid.identify(docs, remainder(4) != 2)
    return found.select("doc_id", (remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op2_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow_rows(spark)  # for the executors' memory
    found = hmm.score(table(spark, sf_dir, "documents"), remainder(10))
    return found.select("doc_id", (F.col("part") == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    # nothing else runs in the session, so time goes before memory
    return packing.pack(table(spark, sf_dir, "documents"), block_bytes=16 << 20, remember=1_000_000)


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    return chat.read_back(chat.format_windows(turns.unionByName(probe)))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


#: Where the key of the pseudonyms is read from, and a key for test data only.
PII_KEY, TEST_KEY = "spark.quern.pii.key", "test data only"


def pii_key(spark: SparkSession) -> bytes:
    return spark.conf.get(PII_KEY, TEST_KEY).encode()


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), pii_key(spark))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(5) != 0)
    return toxicity.score(docs, model).select("doc_id", (remainder(5) == 0).alias("held_out"), "score", "predicted")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op10_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_language, op2_hmm, op3_packing, op4_chat, op5_mixing, op6_pii, op7_neighbours, op8_toxicity, op9_minhash, op10_spotsigs)}

ORACLE: dict[str, str] = {"op4_chat": chat.oracle()}

ORACLE["op7_neighbours"] = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda x: x[1] * x[2]))
           / (sqrt(list_sum(list_transform(q.e, lambda x: x * x))) * sqrt(list_sum(list_transform(c.e, lambda x: x * x)))) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id) AS n FROM p
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
