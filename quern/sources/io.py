"""Scans and sinks: TSV, Parquet, id lists, JSON tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOURCE_COLUMNS = ("entity_id", "business_name", "business_address", "country")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str] = SOURCE_COLUMNS, quoted: bool = True) -> DataFrame:
    """A tab-separated table of strings, missing cells as ''; with ``quoted`` false a quote is a character like others."""
    reader = spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("sep", "\t").option("header", True)
    reader = reader.option("escape", '"').option("multiLine", True) if quoted else reader.option("quote", "")
    return reader.csv(path).na.fill("")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_split(spark: SparkSession, data_dir: str, split: str) -> dict[str, DataFrame]:
    """s1, s2, s3 of a split, and gt where the file exists."""
    base = f"{data_dir}/{split}/{split}"
    out = {f"s{i}": read_tsv(spark, f"{base}_source{i}.tsv") for i in (1, 2, 3)}
    if exists(spark, f"{base}_ground_truth.tsv"):
        out["gt"] = read_tsv(spark, f"{base}_ground_truth.tsv", ("source1_entity_id", "matched_entity_ids"))
    return out


def convert(spark: SparkSession, tsv: str, parquet: str, columns: Sequence[str] = SOURCE_COLUMNS) -> DataFrame:
    """Write a TSV file as Parquet; returns one row: rows parsed and lines without the header."""
    table = read_tsv(spark, tsv, columns, quoted=False)
    table.write.mode("overwrite").parquet(parquet)
    parsed = spark.read.parquet(parquet).agg(F.count("*").alias("n_rows"))
    lines = spark.read.text(tsv).agg((F.count("*") - 1).alias("n_lines"))
    return parsed.join(lines)


def source_tag(c: str = "entity_id") -> Column:
    return F.substring(c, 1, 2)


def id_lists(mapping: DataFrame, s1: DataFrame, column: str = "matched_entity_ids") -> DataFrame:
    """One row per S1 id (source1_entity_id, pos) with its comma list of ``m`` from mapping (s1, m, pos), first mention first."""
    lists = mapping.groupBy("s1").agg(F.array_sort(F.collect_list(F.struct("pos", "m"))).alias("l"))
    joined = s1.join(lists, s1["source1_entity_id"] == lists["s1"], "left")
    ids = F.array_distinct(F.transform(F.coalesce("l", F.array().cast(lists.schema["l"].dataType)), lambda x: x["m"]))
    return joined.select("source1_entity_id", "pos", F.array_join(ids, ",").alias(column))


def write_id_lists(lists: DataFrame, path: str) -> None:
    """One TSV file with a header, in the order of ``pos``."""
    columns = [c for c in lists.columns if c != "pos"]
    lists.orderBy("pos").select(*columns).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The distinct ids in the first column of a TSV file, header and blank lines left out."""
    rows = spark.read.option("header", True).option("sep", "\t").option("quote", "").csv(path)
    return rows.select(F.btrim(F.col(f"`{rows.columns[0]}`")).alias("id")).filter("id <> ''").distinct()


def write_json(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_examples(rows: DataFrame, path: str, order: Sequence[str], n: int = 40) -> None:
    """The first ``n`` rows in an order as one CSV file with a header."""
    rows.orderBy(*order).limit(n).coalesce(1).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_examples(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A CSV table of strings; an empty cell is null."""
    return spark.read.schema(", ".join(f"`{c}` string" for c in columns)).option("header", True).option("escape", '"').csv(path)
