"""F0.5 by entity, threshold curves in one pass, precision and recall."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.windows import best_owner

GRID = tuple(round(0.2 + 0.025 * i, 3) for i in range(31))


def f05(tp: Column, n: Column, n_true: Column) -> Column:
    """Without truth 1 for no prediction, else 0; with truth 0 unless something is right."""
    p, r = tp / F.greatest(n, F.lit(1)), tp / F.greatest(n_true, F.lit(1))
    return F.when(n_true == 0, F.when(n == 0, F.lit(1.0)).otherwise(F.lit(0.0))).when(tp == 0, F.lit(0.0)).otherwise(1.25 * p * r / F.greatest(0.25 * p + r, F.lit(1e-300)))


def truth_counts(s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, n_true) of all S1, those without a match included."""
    return s1.join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").withColumn("n_true", F.coalesce("n_true", F.lit(0)).cast("bigint"))


def by_entity(pred: DataFrame, s1: DataFrame, truth: DataFrame) -> DataFrame:
    """(s1, tp, n, n_true, f05) for predicted pairs (s1, m)."""
    hit = pred.select("s1", "m").join(truth.select("s1", "m", F.lit(1).alias("hit")), ["s1", "m"], "left")
    got = hit.groupBy("s1").agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("tp"), F.count("*").alias("n"))
    rows = truth_counts(s1, truth).join(got, "s1", "left").na.fill(0, ["tp", "n"])
    return rows.withColumn("f05", f05(F.col("tp"), F.col("n"), F.col("n_true")))


def f05_curve(scored: DataFrame, counts: DataFrame, grid: tuple[float, ...] = GRID, by: str | None = None) -> DataFrame:
    """(threshold, macro_f05) for scored pairs (s1, m, label, p) and counts (s1, n_true, ...), by a column of counts if given.

    The best owner of a record doesn't depend on the threshold; each kept pair is expanded to the thresholds it
    reaches, and entities without any pair at a threshold are counted from their totals, so nothing is multiplied by the
    whole grid but the kept pairs.
    """
    best = best_owner(scored.select("s1", "m", "label", "p"), "p")
    steps = F.array(*[F.lit(float(t)) for t in grid])
    reached = best.withColumn("threshold", F.explode(F.filter(steps, lambda t: t <= F.col("p"))))
    got = reached.groupBy("s1", "threshold").agg(F.sum("label").cast("bigint").alias("tp"), F.count("*").alias("n"))
    group = [by] if by else []
    # the part of entities with a prediction, and the rest: 1 for singletons, 0 for the others
    scored_part = got.join(counts, "s1").groupBy("threshold", *group).agg(
        F.sum(F.round(f05(F.col("tp"), F.col("n"), F.col("n_true")), 12)).alias("got"), F.sum((F.col("n_true") == 0).cast("bigint")).alias("single")
    )
    totals = counts.groupBy(*group).agg(F.count("*").alias("n_s1"), F.sum((F.col("n_true") == 0).cast("bigint")).alias("singles"))
    every = totals.withColumn("threshold", F.explode(steps)).join(scored_part, ["threshold", *group], "left")
    value = (F.coalesce("got", F.lit(0.0)) + F.col("singles") - F.coalesce("single", F.lit(0))) / F.col("n_s1")
    return every.select("threshold", *group, F.round(value, 6).alias("macro_f05"))


def best_threshold(curve: DataFrame) -> DataFrame:
    """The first threshold with the largest value."""
    return curve.agg(F.max(F.struct("macro_f05", (-F.col("threshold")).alias("t"))).alias("x")).select((-F.col("x.t")).alias("threshold"), F.col("x.macro_f05").alias("macro_f05"))


def pair_precision_recall(scored: DataFrame, truth: DataFrame, threshold: float) -> DataFrame:
    """(n_kept, n_right, n_true, pair_precision, pair_recall) of the best rows of (s1, m, label, p) that reach the threshold; recall is over
    all true pairs (s1, m), found or not. A share of nothing is null."""
    kept = best_owner(scored, "p").filter(F.col("p") >= threshold)
    sums = kept.agg(F.count("*").alias("n_kept"), F.coalesce(F.sum("label"), F.lit(0)).cast("bigint").alias("n_right"))
    # two tables of one row
    both = sums.join(F.broadcast(truth.agg(F.count("*").alias("n_true"))))
    return both.withColumns({"pair_precision": F.round(F.try_divide("n_right", "n_kept"), 6), "pair_recall": F.round(F.try_divide("n_right", "n_true"), 6)})


def comparison_space(records: DataFrame, microseconds: float = 1.0) -> DataFrame:
    """(country, n_s1, n_other, n_pairs, days): how many pairs a comparison of all would have, by country and (null) overall."""
    c = records.rollup("country").agg(*[F.sum((F.col("src") == "S1").cast("int") if s == "n_s1" else (F.col("src") != "S1").cast("int")).alias(s) for s in ("n_s1", "n_other")])
    n = F.col("n_s1").cast("double") * F.col("n_other")
    return c.select("country", "n_s1", "n_other", n.alias("n_pairs"), (n * microseconds / 86400e6).alias("days"))


def candidate_recall(cand: DataFrame, truth: DataFrame) -> DataFrame:
    """(n_hits, n_true, recall): recall is 1 when nothing is true."""
    hit = truth.select("s1", "m").distinct().join(cand.select("s1", "m", F.lit(1).alias("hit")).distinct(), ["s1", "m"], "left")
    sums = hit.agg(F.coalesce(F.sum("hit"), F.lit(0)).cast("bigint").alias("n_hits"), F.count("*").alias("n_true"))
    return sums.withColumn("recall", F.when(F.col("n_true") == 0, F.lit(1.0)).otherwise(F.round(F.try_divide("n_hits", "n_true"), 6)))


def majority(counts: DataFrame, key: str, value: str, n: str, min_count: int, min_purity: float) -> DataFrame:
    """(key, value, n, total) of keys whose most frequent value (ties: smaller value) has the support and the purity."""
    w = Window.partitionBy(key)
    ranked = counts.withColumn("total", F.sum(n).over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc(n), value)))
    return ranked.filter((F.col("_r") == 1) & (F.col(n) >= min_count) & (F.col(n) >= F.col("total") * F.lit(min_purity))).drop("_r")
