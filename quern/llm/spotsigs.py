"""SpotSigs fingerprints, in DataFrame operations only.

A spot is a common word (an anchor) with the chain of the next ``CHAIN`` content words; a text's signature is the set of
the hashes of its spots, and its fingerprint that set as sorted hexadecimal numbers. Texts are compared through the
Jaccard similarity of their sets, pruned by set length: for a threshold t sets fall into length classes whose bounds
grow by 1 / t, and only sets of one class or of neighbouring ones can be similar.

A text without a spot has one signature, the hash of the whole text, so equal texts always have equal fingerprints.

Finding each document's successor in doc_id order takes no global sort: doc_ids are cut into ranges at approximate
quantiles, a window over each range gives the next document, and the last of a range takes the first of the next range
from a table with one row per range.

Edge cases: null text counts as empty; null doc_ids come first, rows with equal doc_id follow each other by text; a lone
document is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import partitions, row_keys, small, stage

CHAIN = 2
#: Common words of English, French, German and Spanish that serve as anchors (fixed values).
ANCHORS = (
    "the a an and of to in is was that for it on with as be by at are this from or were he she not but have had his her they you we "
    "le la les de des du et un une en que est pour dans qui sur par avec au aux pas ce il elle ne se plus sont "
    "der die das und den von zu mit ist im dem ein eine nicht auf für sich auch als an es er sie wird aus bei nach "
    "el los las y del con por una no para su al lo como más pero sus o ha"
).split()
NON_WORD = r"[^\p{L}\p{N}]+"
LEAST = -(2**63)


def with_spots(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add ``out``, the sorted distinct spot signatures (40-bit numbers) of a column without nulls."""
    anchors = sorted(set(ANCHORS))
    df = df.withColumn("_w", F.filter(F.split(F.lower(text), NON_WORD), lambda x: x != ""))
    df = df.withColumn("_a", F.filter(F.transform("_w", lambda x, i: F.when(x.isin(anchors), i).otherwise(-1)), lambda i: i >= 0))
    df = df.withColumn("_c", F.filter("_w", lambda x: ~x.isin(anchors)))

    def spot(p: Column, k: Column) -> Column:
        # the words before position p are k anchors and p - k content words
        following = [F.coalesce(F.get("_c", p - k + j), F.lit("")) for j in range(chain)]
        return F.when(p - k < F.size("_c"), F.shiftrightunsigned(F.xxhash64(F.get("_w", p), *following), 24))

    df = df.withColumn("_s", F.array_sort(F.array_distinct(F.array_compact(F.transform("_a", spot)))))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.col(text)), 24))
    return df.withColumn(out, F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole)).drop("_w", "_a", "_c", "_s")


def fingerprint(signatures: str) -> Column:
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), " ")


def length_class(signatures: str, threshold: float) -> Column:
    """The class of a set's length; sets whose classes differ by more than one have a similarity below the threshold."""
    return F.floor(F.log(F.greatest(F.size(signatures), F.lit(1))) / math.log(1 / threshold)).cast("int")


def jaccard(a: str, b: str, threshold: float | None = None) -> Column:
    """Jaccard similarity of two signature sets; with a threshold, 0 without a comparison where length rules it out."""
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    if threshold is None:
        return exact
    apart = F.abs(length_class(a, threshold) - length_class(b, threshold)) > 1
    short = F.least(F.size(a), F.size(b)) < F.greatest(F.size(a), F.size(b)) * F.lit(threshold)
    return F.when(apart | short, F.lit(0.0)).otherwise(exact)


def ranges(docs: DataFrame, key: Column, many: int) -> Column:
    """The number of the doc_id range that ``key`` falls into, of about ``many`` ranges of like row counts."""
    outer = max(1, math.isqrt(many))
    inner = max(1, many // outer)
    points = [i / (outer * inner) for i in range(1, outer * inner)]
    if not points:
        return F.lit(0)
    cuts = docs.agg(F.percentile_approx(key, points, max(10_000, 20 * many)).alias("cuts")).first()["cuts"]
    if not cuts:
        return F.lit(0)
    cuts = [int(c) for c in cuts]
    # two steps, so that a row is compared with about 2 sqrt(many) cuts
    coarse = F.array(*[F.lit(cuts[i * inner - 1]) for i in range(1, outer)]) if outer > 1 else F.array().cast("array<bigint>")
    groups = [cuts[i * inner : i * inner + inner - 1] for i in range(outer)]
    fine = F.array(*[F.array(*map(F.lit, g)) if g else F.array().cast("array<bigint>") for g in groups])
    upper = F.size(F.filter(coarse, lambda c: c < key))
    return (upper * inner + F.size(F.filter(F.get(fine, upper), lambda c: c < key))).cast("int")


def successors(docs: DataFrame, columns: list[str], many: int) -> DataFrame:
    """docs with ``next_<column>`` of the next row by (_key, text), the first row's for the last; ``_key`` is not null."""
    ids = docs.select("_key")
    docs = docs.withColumn("_range", ranges(ids, F.col("_key"), many))
    # at most ``many`` ranges, so this table is bounded
    firsts = docs.groupBy("_range").agg(F.min("_key").alias("first")).orderBy("_range").collect()
    if not firsts:
        return docs.select("*", *[F.col(c).alias(f"next_{c}") for c in columns]).drop("_range")
    follow = [(a["_range"], firsts[(i + 1) % len(firsts)]["first"]) for i, a in enumerate(firsts)]
    spark = docs.sparkSession
    heads = docs.filter(F.col("_key").isin([r["first"] for r in firsts]))
    order = Window.partitionBy("_key").orderBy("text")
    heads = heads.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(F.col("_key").alias("_first"), F.struct(*columns).alias("_head"))
    links = spark.createDataFrame(follow, "_range int, _first long")
    edges = F.broadcast(links).join(heads, "_first").select("_range", "_head")
    ahead = docs.withColumn("_next", F.lead(F.struct(*columns)).over(Window.partitionBy("_range").orderBy("_key", "text")))
    joined = ahead.join(edges, "_range", "left").withColumn("_next", F.coalesce("_next", "_head"))
    return joined.select(*[c for c in docs.columns if c != "_range"], *[F.col(f"_next.{c}").alias(f"next_{c}") for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for docs (doc_id, text).

    The edited text has the last floor(n / 2) code points replaced by the first as many of the next document's text.
    """
    many = min(4096, 2 * partitions(docs.sparkSession))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(LEAST)).alias("_key"), F.coalesce("text", F.lit("")).alias("text"))
    # signatures come after the shuffle: computing the successor's once more is cheaper than moving all of them
    rows = successors(rows, ["text"], many)
    rows = rows.withColumn("n_chars", F.length("text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars") - half), F.substr("next_text", F.lit(1), half)))
    for text, out in (("text", "spots"), ("next_text", "next_spots"), ("edited", "edited_spots")):
        rows = with_spots(rows, text, out)
    return rows.select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("spots").alias("fingerprint"), fingerprint("edited_spots").alias("edited_fingerprint"),
        jaccard("spots", "edited_spots").alias("near_edited"), jaccard("spots", "next_spots").alias("near_next"),
    )


def similar(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of docs (doc_id, text): members (doc_id, class_id) has a row per document, whose class is that of all
    equal fingerprints and named by its smallest doc_id (null ids last); pairs (class_a, class_b, near) has all pairs of different
    classes whose Jaccard similarity reaches the threshold.

    Class representatives are dealt out by set length: a set meets those of its own length class and of the next shorter one,
    at one of its rarest spots, of which a similar set must have one. Equal sets never meet, so copies cost nothing here.
    """
    rows = row_keys(docs.select("doc_id", "text"), "_row").withColumn("text", F.coalesce("text", F.lit("")))
    signed = stage(with_spots(rows, "text", "spots").withColumn("mark", F.sha2(fingerprint("spots"), 256)).select("_row", "doc_id", "mark", "spots"))
    heads = stage(signed.groupBy("mark").agg(F.min("_row").alias("head")))
    members = signed.select("_row", "doc_id", "mark").join(small(heads), "mark")
    names = signed.select(F.col("_row").alias("head"), F.col("doc_id").alias("class_id"))
    sets = stage(signed.join(small(heads.select(F.col("head").alias("_row"))), "_row", "left_semi").select(F.col("_row").alias("head"), "spots", F.size("spots").alias("n"), length_class("spots", threshold).alias("part")))
    at = sets.select("head", "n", "part", F.explode("spots").alias("spot"))
    counts = stage(at.groupBy("spot").agg(F.count("*").alias("df")).filter("df > 1"))
    nth = Window.partitionBy("head")
    ranked = at.join(small(counts), "spot").withColumn("r", F.row_number().over(nth.orderBy("df", "spot"))).withColumn("shared", F.count("*").over(nth))
    # spots of this set alone come first and take their places; a similar set has one of the first n - ceil(t n) + 1
    prefix = stage(ranked.filter(F.col("r") + F.col("n") - F.col("shared") <= F.col("n") - F.ceil(F.col("n") * F.lit(threshold) - 1e-9) + 1).select("head", "n", "part", "spot"))
    a = prefix.select("spot", F.col("head").alias("a"), F.col("n").alias("na"), F.col("part").alias("pa"), F.explode(F.array("part", F.col("part") - 1)).alias("part"))
    b = prefix.select("spot", F.col("head").alias("b"), F.col("n").alias("nb"), "part")
    once = F.when(F.col("pa") == F.col("part"), F.col("a") < F.col("b")).otherwise(F.lit(True))
    met = a.join(b, ["spot", "part"]).filter(once & (F.least("na", "nb") >= F.greatest("na", "nb") * F.lit(threshold) - 1e-9)).select("a", "b").distinct()
    both = met.join(sets.select(F.col("head").alias("b"), F.col("spots").alias("sb")), "b").join(sets.select(F.col("head").alias("a"), F.col("spots").alias("sa")), "a")
    near = both.withColumn("near", jaccard("sa", "sb", threshold)).filter(F.col("near") >= threshold)
    first = lambda c, out: names.select(F.col("head").alias(c), F.col("class_id").alias(out))
    pairs = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "near").join(first("a", "class_a"), "a").join(first("b", "class_b"), "b")
    return members.join(names, "head").select("doc_id", "class_id"), pairs.select("class_a", "class_b", "near")
