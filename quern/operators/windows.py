"""Competition features of scored pairs by window functions, assignment, and top-k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(score: str, *key: str) -> Column:
    """Rank by falling score, ties get the smallest."""
    return F.rank().over(Window.partitionBy(*key).orderBy(F.desc(score)))


def group_max(score: str, *key: str) -> Column:
    return F.max(score).over(Window.partitionBy(*key))


def gap_to_best(score: str, *key: str) -> Column:
    return group_max(score, *key) - F.col(score)


def second_best(score: str, *key: str) -> Column:
    """The score of the second row of the group, -1 for a group of one."""
    w = Window.partitionBy(*key).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.coalesce(F.nth_value(score, 2).over(w), F.lit(-1.0))


def margin(score: str, *key: str) -> Column:
    """Lead over the runner-up for the best row, distance to the best for the others."""
    best = group_max(score, *key)
    return F.when(F.col(score) >= best, F.col(score) - second_best(score, *key)).otherwise(F.col(score) - best)


def group_size(*key: str) -> Column:
    return F.count(F.lit(1)).over(Window.partitionBy(*key))


def context_features(pairs: DataFrame, score: str, prefix: str) -> DataFrame:
    """The six competition features of pairs (s1, m, score): two shuffles, one by s1 and one by m."""
    return pairs.withColumns({
        f"{prefix}_rank_in_s1": rank_in_group(score, "s1").cast("float"),
        f"{prefix}_gap_s1_best": gap_to_best(score, "s1"),
    }).withColumns({
        f"{prefix}_rank_in_m": rank_in_group(score, "m").cast("float"),
        f"{prefix}_gap_m_best": gap_to_best(score, "m"),
        f"{prefix}_margin_m": margin(score, "m"),
        f"{prefix}_n_s1_for_m": group_size("m").cast("smallint"),
    })


def top_k(pairs: DataFrame, key: list[str], score: str, ties: list[str], k: int, rank: str = "rank") -> DataFrame:
    """The k best rows of each key; ``row_number`` with a limit lets Spark cut groups before the shuffle."""
    order = Window.partitionBy(*key).orderBy(F.desc(score), *ties)
    return pairs.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= k)


def best_owner(pairs: DataFrame, score: str = "p") -> DataFrame:
    """Each record's best S1 (ties: smaller s1)."""
    return top_k(pairs, ["m"], score, ["s1"], 1, "_r").drop("_r")


def assign(pairs: DataFrame, score: str, threshold: float) -> DataFrame:
    """(s1, matched): every record goes to its best S1 if the score reaches the threshold."""
    kept = best_owner(pairs.filter(F.col(score) >= threshold), score)
    return kept.groupBy("s1").agg(F.array_sort(F.collect_set("m")).alias("matched"))
