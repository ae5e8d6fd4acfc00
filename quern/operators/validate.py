"""Validation of id-list files: every rule in one pass over the lines, reported as (severity, rule, n, examples)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.text import parse_id_list
from quern.sources.io import exists

EXAMPLES = 5
REPORT = "severity string, rule string, n bigint, examples string"


def parsed(lines: DataFrame) -> DataFrame:
    """Lines (value, no header) as (s1, ids, malformed); blank lines are left out."""
    rows = lines.filter(F.btrim("value") != "")
    tab = F.instr("value", "\t") > 0
    s1 = F.btrim(F.split_part("value", F.lit("\t"), F.lit(1)))
    ids = F.transform(parse_id_list(F.split_part("value", F.lit("\t"), F.lit(2))), lambda x: F.btrim(x))
    return rows.select(F.when(tab, s1).otherwise(F.col("value")).alias("s1"), F.when(tab, F.filter(ids, lambda x: x != "")).otherwise(F.array().cast("array<string>")).alias("ids"), (~tab).alias("malformed"))


def found(rows: DataFrame, rule: str, what: Column | str, severity: str = "error") -> DataFrame:
    """One row: how many offenders and the first five in order. Only the counts and five values leave each task."""
    bad = rows.select((F.col(what) if isinstance(what, str) else what).alias("x"))
    few = bad.orderBy("x").limit(EXAMPLES).agg(F.coalesce(F.array_join(F.array_sort(F.collect_list("x")), ","), F.lit("")).alias("examples"))
    n = bad.agg(F.count("*").alias("n"))
    return n.join(F.broadcast(few)).select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")


def validate(rows: DataFrame, required: DataFrame, known: DataFrame | None = None, candidates: DataFrame | None = None) -> DataFrame:
    """The rules on parsed rows (s1, ids, malformed), required S1 ids (s1), known ids (id) and a candidate file's parsed rows."""
    good = rows.filter(~F.col("malformed"))
    has = lambda f: F.exists("ids", f)
    own = lambda x: x.startswith("S1-")
    other = lambda x: ~x.startswith("S1-") & ~x.startswith("S2-") & ~x.startswith("S3-")
    out = [
        found(rows.filter("malformed"), "malformed_row", "s1"),
        found(good.groupBy("s1").count().filter("count > 1"), "duplicate_s1", "s1"),
        found(good.filter(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate_id", "s1"),
        found(good.filter(has(own)), "self_match", "s1"),
        found(good.filter(has(other)), "bad_prefix", "s1"),
        found(required.join(good.select("s1"), "s1", "left_anti"), "missing_s1", "s1"),
        found(good.join(required, "s1", "left_anti"), "extra_s1", "s1"),
    ]
    if known is not None:
        ids = good.select(F.explode("ids").alias("id")).distinct()
        out.append(found(ids.join(known, "id", "left_anti"), "unknown_id", "id"))
    if candidates is not None:
        theirs = candidates.filter(~F.col("malformed")).groupBy("s1").agg(F.array_distinct(F.flatten(F.collect_list("ids"))).alias("c"))
        joined = good.join(theirs, "s1", "left")
        out.append(found(joined.filter(F.size(F.array_except("ids", F.coalesce("c", F.array().cast("array<string>")))) > 0), "not_a_candidate", "s1", "warning"))
    return reduce(DataFrame.unionByName, out)


def validate_file(spark: SparkSession, path: str, column: str, required: DataFrame, known: DataFrame | None = None, candidates: str | None = None) -> tuple[int, DataFrame]:
    """(exit code, report) of a result file: 1 if any error was found, fatal header problems included."""

    def fatal(rule: str) -> tuple[int, DataFrame]:
        return 1, spark.createDataFrame([("fatal", rule, 1, path)], REPORT)

    if not exists(spark, path):
        return fatal("file_missing")
    lines = spark.read.text(path)
    head = lines.limit(1).collect()
    if not head:
        return fatal("file_empty")
    header = head[0]["value"]
    if "\t" not in header:
        return fatal("comma_header" if "," in header else "wrong_header")
    if [x.strip().lower() for x in header.split("\t")] != ["source1_entity_id", column]:
        return fatal("wrong_header")
    again = lines.filter(F.col("value") == header).count() - 1  # a repeated header is a row like others
    body = parsed(lines.filter(F.col("value") != header).unionByName(spark.range(again).select(F.lit(header).alias("value"))))
    theirs = parsed(spark.read.text(candidates)) if candidates and exists(spark, candidates) else None
    report = validate(body, required, known, theirs)
    errors = report.filter("severity = 'error' and n > 0").limit(1).count()
    return int(errors > 0), report
