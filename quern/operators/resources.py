"""Dictionaries learned from matched pairs: native-script states and native tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import tables as T
from quern.functions.text import clean_text, fold, romanize, s1_state, spaced_tokens, squash_phonetic, tokens
from quern.operators.metrics import majority

STATE_COUNT, STATE_PURITY, TOKEN_COUNT, TOKEN_PURITY = 5, 0.8, 3, 0.6


def learn_states(pairs: DataFrame, min_count: int = STATE_COUNT, min_purity: float = STATE_PURITY) -> DataFrame:
    """(key, value): native address component to state code, from pairs (s1_addr, m_addr)."""
    rows = pairs.filter(F.col("m_addr").rlike(T.INDIC)).withColumn("value", s1_state(F.col("s1_addr"))).filter("value is not null")
    parts = rows.select("value", F.explode(F.transform(F.split("m_addr", ","), lambda x: F.btrim(x))).alias("key")).filter(F.col("key").rlike(T.INDIC))
    return majority(parts.groupBy("key", "value").agg(F.count("*").alias("n")), "key", "value", "n", min_count, min_purity).select("key", "value")


def learn_tokens(pairs: DataFrame, min_count: int = TOKEN_COUNT, min_purity: float = TOKEN_PURITY) -> DataFrame:
    """(key, value): skeleton of a romanised token to the S1 token at its place, from pairs (s1_name, m_name) of equal length."""
    rows = pairs.filter(F.col("m_name").rlike(T.INDIC)).select(tokens(clean_text(fold(F.col("s1_name")))).alias("a"), spaced_tokens(romanize(F.col("m_name"))).alias("b"))
    aligned = rows.filter(F.size("a") == F.size("b")).select(F.inline(F.arrays_zip(F.col("b"), F.col("a"))))
    counts = aligned.select(squash_phonetic(F.col("b")).alias("key"), F.col("a").alias("value")).filter("key <> ''").groupBy("key", "value").agg(F.count("*").alias("n"))
    return majority(counts, "key", "value", "n", min_count, min_purity).select("key", "value")


def as_map(learned: DataFrame, most: int = 50_000):
    """A learned dictionary as a map literal; it has one entry per frequent native word, and a bound that is checked."""
    rows = learned.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} entries; join the dictionary instead")
    if not rows:
        return None
    return F.create_map(*[F.lit(x) for r in sorted(rows) for x in (r["key"], r["value"])])
