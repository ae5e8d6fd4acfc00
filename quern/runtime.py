"""Session-level helpers: scratch tables in the shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow side (a few short columns) may be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000

_own: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        _own[app] = f"file://{tempfile.mkdtemp(prefix='quern-')}"
    return _own[app]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit; the folder is scratch
        pass


def stage(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet to the shared scratch folder and return a scan of it.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation. The files go when the driver exits.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/quern/{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_drop, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it holds at most ``rows`` rows, else unchanged (a shuffle join follows)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str, rows: int = 1_000, tasks: int = 8) -> DataFrame:
    """``df`` dealt over as many partitions as its rows fill, up to ``tasks`` a core: a file of a few MB is one scan task,
    and the work on its rows or pairs would stay in that task."""
    n = min(-(-df.count() // rows), tasks * df.sparkSession.sparkContext.defaultParallelism)
    return df.repartition(max(n, 1), *keys)


def unique_ids(docs: DataFrame) -> bool:
    """Whether no doc_id is null or occurs twice."""
    return not docs.groupBy("doc_id").count().filter("count > 1 or doc_id is null").limit(1).count()


def row_keys(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a long column ``key`` that each row has alone and that grows with doc_id (nulls last), then with the text's hash.

    It is doc_id where no doc_id is null or occurs twice; else the rows are sorted, numbered and written once with their texts.
    """
    if unique_ids(docs):
        return docs.withColumn(key, F.col("doc_id"))
    rows = docs.sort(F.col("doc_id").asc_nulls_last(), F.xxhash64("text"))
    return stage(rows.withColumn(key, F.monotonically_increasing_id()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_rows(spark: SparkSession, most: int = 2_000) -> None:
    """Lower the session's Arrow batches to ``most`` rows: with whole texts, the default of 10,000 rows is tens of MB on both sides of a socket."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, str(most))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
