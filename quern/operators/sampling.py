"""Deterministic samples and splits by md5, the same in every engine and at every partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import stage


def bucket(ident: Column, seed: int | str) -> Column:
    """A number from 0 to 2**32 - 1 from the identifier and a seed."""
    return F.conv(F.substring(F.md5(F.concat(ident.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("bigint")


def split(df: DataFrame, ident: str, seed: int = 42, validation: float = 0.1) -> DataFrame:
    """Add ``fold``: val for the given share of identifiers, else train."""
    return df.withColumn("fold", F.when(bucket(F.col(ident), seed) < int(validation * 2**32), F.lit("val")).otherwise(F.lit("train")))


def halves(df: DataFrame, ident: str, seed: int = 0) -> DataFrame:
    return df.withColumn("half", (bucket(F.col(ident), f"half{seed}") % 2).cast("int"))


def sample(df: DataFrame, ident: str, n: int, seed: int = 0) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(bucket(F.col(ident), seed), ident).limit(n)


def with_replacement(df: DataFrame, key: str, ident: str, n: int, seed: int = 0) -> DataFrame:
    """For each key, ``n`` draws of its rows: (key, draw, row columns). Rows are numbered, and draws join on the number.

    Rows are numbered in 256 buckets of each key by the identifier's hash, in the order of bucket and identifier; so a
    key that holds most rows is numbered by many tasks.
    """
    dealt = df.withColumn("_b", F.substring(F.md5(F.col(ident).cast("string")), 1, 2))
    sizes = stage(dealt.groupBy(key, "_b").agg(F.count("*").alias("_n")))
    before = sizes.withColumn("_before", F.sum("_n").over(Window.partitionBy(key).orderBy("_b")) - F.col("_n"))
    totals = sizes.groupBy(key).agg(F.sum("_n").alias("_n"))
    draws = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("_i", bucket(F.concat_ws(":", F.col(key), F.col("draw").cast("string")), seed) % F.col("_n"))
    # the bucket that holds each drawn number, and the number within it
    placed = draws.drop("_n").join(before, key).filter((F.col("_i") >= F.col("_before")) & (F.col("_i") < F.col("_before") + F.col("_n")))
    wanted = placed.select(key, "draw", "_b", (F.col("_i") - F.col("_before") + 1).alias("_i"))
    numbered = dealt.withColumn("_i", F.row_number().over(Window.partitionBy(key, "_b").orderBy(ident)).cast("bigint"))
    return wanted.join(numbered, [key, "_b", "_i"]).drop("_b", "_i")
