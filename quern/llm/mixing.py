"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame operations only.

1. Targets: the sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words; a target stops
   at ``cap`` times its source's words and the excess is shared again by weight. With the sources sorted by cap over
   weight this has a closed form over prefix sums, so one pass over the (small) source table does it.
2. Blocks: the mix is made of blocks of ``block_words`` words. Sources get blocks by the highest quotients
   target / (2k + 1); within a source its shards get them in the same way by shard words.
3. Selection: a shard's documents lie in a seeded order and form a circle of words. A shard that gets q blocks of its
   n words takes the whole circle floor(q * block / n) times and the rest as a run of blocks from a seeded start.

Shards per source follow from the source's words, so a hot source is dealt over as many groups as it needs.

Edge cases: a null or empty text has size 0 and is taken 0 times; an empty table gives an empty result; a null source is
a source of its own; rows with equal doc_id are separate rows; other columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._text import WORD, free
from quern.runtime import partitions, small, stage

WEIGHTS = (5, 2, 1)
CAP = 3
BLOCK_WORDS = 32
SHARD_WORDS = 2_000_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """Add ``target`` to a table (source, source_size) with one row per source."""
    every = Window.partitionBy(F.lit(0))
    nth = F.row_number().over(every.orderBy(F.col("source").isNull(), F.col("source")))
    weighed = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (nth - 1) % len(weights) + 1))
    limit = F.col("source_size") * float(cap)
    order = every.orderBy(limit / F.col("weight"), F.col("source").isNull(), F.col("source"))
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    share = (F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(upto), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))
    )
    shared = weighed.withColumn("_share", share).withColumn("_nth", F.row_number().over(order))
    open_ = F.when(F.col("_share") <= limit / F.col("weight"), F.col("_nth"))
    level = F.min(F.when(open_.isNotNull(), F.struct(open_.alias("n"), F.col("_share").alias("s")))).over(every)["s"]
    target = F.coalesce(F.least(limit, level * F.col("weight")), limit)
    return shared.withColumn("target", target).drop("_share", "_nth")


def apportion(df: DataFrame, group: list[str], votes: str, seats: str, ident: list[str], out: str) -> DataFrame:
    """Sainte-Lague: add ``out``, the seats of each row out of its group's ``seats``, by the highest quotients votes / (2k + 1).

    A few Newton steps bring the divisor so close that only three quotients to either side of v / divisor need ranking.
    """
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    d = df.withColumn("_v", F.col(votes).cast("double"))
    d = d.withColumn("_d", F.try_divide(F.sum("_v").over(g), F.col(seats).cast("double")))
    for _ in range(4):
        given = F.sum(F.floor(F.coalesce(F.try_divide(F.col("_v"), F.col("_d")), F.lit(0.0)) + 0.5)).over(g)
        d = d.withColumn("_d", F.col("_d") * F.greatest(given, F.lit(1)) / F.greatest(F.col(seats), F.lit(1)))
    d = d.withColumn("_base", F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide(F.col("_v"), F.col("_d")), F.lit(0.0)) + 0.5) - 3).cast("long"))
    d = d.withColumn("_left", F.col(seats) - F.sum("_base").over(g))
    cand = d.withColumn("_k", F.explode(F.sequence(F.col("_base"), F.col("_base") + 6)))
    rank = F.row_number().over(g.orderBy(F.desc(F.col("_v") / (2 * F.col("_k") + 1)), *[F.col(c) for c in ident], F.col("_k")))
    cand = cand.withColumn("_won", ((rank <= F.col("_left")) & (F.col("_v") > 0)).cast("long"))
    keep = [c for c in df.columns]
    return cand.groupBy(*keep, "_base").agg(F.sum("_won").alias("_w")).withColumn(out, F.col("_base") + F.col("_w")).drop("_base", "_w")


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = WEIGHTS,
    cap: int = CAP,
    block_words: int = BLOCK_WORDS,
    shard_words: int = SHARD_WORDS,
    seed: int = 7,
    key: str = "doc_id",
) -> DataFrame:
    """doc_id (or the column ``key``), size, source_size, target, taken; and what is taken: ``copies`` whole texts, then words
    [part_from, part_to) and [head_from, head_to)."""
    rows = stage(docs.select(F.col(key).alias("doc_id"), "source", size_of(F.col("text")).alias("size")))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = sources.withColumn("_seats", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(0))) / block_words).cast("long"))
    sources = apportion(sources, [], "target", "_seats", ["source"], "blocks")
    sources = sources.withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    skey = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")).alias("skey")
    sources = stage(sources.select(skey, "source_size", "target", "blocks", "n_shards"))
    placed = rows.select("doc_id", "size", skey).join(small(sources, 100_000), "skey")
    placed = placed.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.col("n_shards")))
    shards = placed.groupBy("skey", "shard").agg(F.sum("size").alias("words"), F.max("blocks").alias("blocks"))
    shards = apportion(shards, ["skey"], "words", "blocks", ["shard"], "quota")
    take = F.least(F.col("quota") * block_words, F.col("words") * cap)
    n_blocks = F.greatest(F.lit(1), F.floor(F.col("words") / block_words))
    shards = shards.select(
        "skey", "shard", "words",
        F.coalesce(F.floor(F.try_divide(take, F.col("words"))), F.lit(0)).cast("long").alias("copies"),
        F.coalesce(F.when(F.col("words") > 0, take % F.greatest(F.col("words"), F.lit(1))), F.lit(0)).alias("rest"),
        (F.pmod(F.xxhash64("skey", "shard", F.lit(seed + 1)), n_blocks) * block_words).alias("start"),
    )
    shards = small(stage(shards.repartition(partitions(docs.sparkSession), "skey", "shard")), 300_000)
    order = Window.partitionBy("skey", "shard").orderBy(F.xxhash64("doc_id", F.lit(seed + 2)), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn("at", F.sum("size").over(order) - F.col("size")).join(shards, ["skey", "shard"])
    at, end, stop = F.col("at"), F.col("at") + F.col("size"), F.col("start") + F.col("rest")

    def cut(lo: Column, hi: Column) -> tuple[Column, Column]:
        a, b = F.greatest(at, lo) - at, F.least(end, hi) - at
        return F.when(b > a, a).otherwise(F.lit(0)).cast("long"), F.when(b > a, b).otherwise(F.lit(0)).cast("long")

    a, b = cut(F.col("start"), F.least(stop, F.col("words")))
    c, d = cut(F.lit(0), stop - F.col("words"))
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(F.lit(0))
    return placed.select(
        F.col("doc_id").alias(key), "size", "source_size", F.col("target").cast("double").alias("target"),
        (copies * F.col("size") + (b - a) + (d - c)).cast("long").alias("taken"),
        copies.cast("long").alias("copies"), a.alias("part_from"), b.alias("part_to"), c.alias("head_from"), d.alias("head_to"),
    )


def realize(docs: DataFrame, plan: DataFrame, key: str = "doc_id") -> DataFrame:
    """The mixed documents with the columns of ``docs``: whole copies, and parts as their words joined by single spaces.

    ``key`` has to be unique in ``docs`` and not null (``runtime.row_keys`` makes one); a document that the mix doesn't take has no row.
    """
    names = ("size", "copies", "part_from", "part_to", "head_from", "head_to")
    took, split, made = (free(docs, c) for c in ("_mix", "_split", "_out"))
    p = plan.select(key, F.struct(*names).alias(took))
    size, copies, part_from, part_to, head_from, head_to = (F.col(f"{took}.{c}") for c in names)
    cut = (part_to > 0) | (head_to > 0)
    joined = docs.join(small(p, 300_000), key).withColumn(split, F.when(cut, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))))

    def part(a: Column, b: Column) -> Column:
        whole = (a == 0) & (b == size)
        return F.when(b > a, F.when(whole, F.col("text")).otherwise(F.array_join(F.slice(split, (a + 1).cast("int"), (b - a).cast("int")), " ")))

    texts = F.concat(F.array_repeat(F.col("text"), copies.cast("int")), F.array_compact(F.array(part(part_from, part_to), part(head_from, head_to))))
    out = joined.withColumn(made, F.explode(texts))
    return out.select(*[F.col(made).alias("text") if c == "text" else F.length(made).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])
