"""Blocking keys, oversize blocks, and how well keys find true pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import nth_token
from quern.runtime import small

#: Rows on the S2/S3 side beyond which a block is dropped.
OVERSIZE = 2000


def keys() -> dict[str, Column]:
    """Blocking keys of normalised records; a key whose last part is empty is no key."""
    c = F.col
    return {
        "core": F.concat_ws("|", c("country"), c("name_core")),
        "first_state": F.concat_ws("|", c("country"), nth_token(c("name_core"), 0), c("addr_state")),
        "first": F.concat_ws("|", c("country"), nth_token(c("name_core"), 0)),
        "house_street": F.concat_ws("|", c("country"), c("addr_house"), nth_token(c("addr_norm"), 1)),
    }


def keyed(records: DataFrame, key: Column) -> DataFrame:
    """(entity_id, src, key) of records that have the key."""
    return records.select("entity_id", "src", key.alias("key")).filter(~F.col("key").endswith("|"))


def oversize(rows: DataFrame, limit: int = OVERSIZE) -> DataFrame:
    """Keys with more than ``limit`` rows outside S1, with their row counts."""
    return rows.filter("src <> 'S1'").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > limit)


def block_pairs(rows: DataFrame, limit: int = OVERSIZE) -> DataFrame:
    """(s1, m) that share a key. Blocks are bounded by ``limit`` on the side of m, so a key fans out no further."""
    sizes = rows.filter("src <> 'S1'").groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") <= limit).select("key")
    right = rows.filter("src <> 'S1'").join(sizes, "key", "left_semi").select("key", F.col("entity_id").alias("m"))
    left = rows.filter("src = 'S1'").select("key", F.col("entity_id").alias("s1"))
    return left.join(right, "key").select("s1", "m")


def union_pairs(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).distinct()


def report(rows: DataFrame, truth: DataFrame, limit: int = OVERSIZE) -> DataFrame:
    """n_pairs, n_hits, recall_pct, cands_per_s1, max_block, dropped_s1_pct of one key."""
    pairs = block_pairs(rows, limit)
    hits = pairs.join(truth.select("s1", "m").withColumn("hit", F.lit(1)), ["s1", "m"], "left")
    found = hits.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("n_hits"))
    true = truth.agg(F.count("*").alias("n_true"))
    blocks = rows.filter("src <> 'S1'").groupBy("key").agg(F.count("*").alias("n"))
    largest = blocks.filter(F.col("n") <= limit).agg(F.coalesce(F.max("n"), F.lit(0)).alias("max_block"))
    s1 = rows.filter("src = 'S1'").join(small(blocks.filter(F.col("n") > limit).select("key", F.lit(1).alias("over"))), "key", "left")
    share = s1.agg(F.count("*").alias("n_s1"), F.coalesce(F.sum("over"), F.lit(0)).alias("n_over"))
    # five tables of one row each
    one = reduce(lambda a, b: a.join(F.broadcast(b)), [found, true, largest, share])
    return one.select(
        "n_pairs", "n_hits", F.round(100.0 * F.try_divide("n_hits", "n_true"), 4).alias("recall_pct"),
        F.round(F.try_divide("n_pairs", "n_s1"), 4).alias("cands_per_s1"), "max_block",
        F.round(100.0 * F.try_divide("n_over", "n_s1"), 4).alias("dropped_s1_pct"),
    )


def precision(rows: DataFrame, truth: DataFrame, limit: int = OVERSIZE) -> DataFrame:
    pairs = block_pairs(rows, limit).join(truth.select("s1", "m", F.lit(1).alias("hit")), ["s1", "m"], "left")
    return pairs.agg(F.count("*").alias("n_pairs"), F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("n_true"), F.round(100.0 * F.avg(F.coalesce("hit", F.lit(0))), 4).alias("precision_pct"))


def explain(records: DataFrame, entity_id: str) -> DataFrame:
    """The blocks of one entity: per key its value and how many records outside S1 share it."""
    out = []
    for name, key in keys().items():
        rows = keyed(records, key)
        mine = rows.filter(F.col("entity_id") == entity_id).select("key")
        out.append(rows.filter("src <> 'S1'").join(F.broadcast(mine.limit(1)), "key").groupBy("key").agg(F.count("*").alias("n")).select(F.lit(name).alias("block"), "key", "n"))
    return reduce(DataFrame.unionByName, out)
