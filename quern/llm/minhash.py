"""Near-duplicate groups by fast similarity sketches, banding and exact verification.

Sketch (fast similarity sketching): round i < t throws every shingle into a hashed bin of t and keeps i plus the least
hash there; round t + i throws all shingles into bin i, so every coordinate fills. Rounds stop for a document as soon as
its bins are full, and values of an earlier round win, so coordinates collide with the Jaccard similarity and their mean
is concentrated as for t independent hashes.

Plan:
1. One pass over the texts: number of shingles, a digest of the whole word sequence, the band keys of the sketch.
2. Equal word sequences are one class; only its smallest doc_id goes on.
3. Buckets (band keys) with two members or more. A bucket proposes the pairs of its centre, the member that shares most
   buckets, with the others; every proposal is verified on the full shingle sets, and the links found join components.
   Then buckets of at most ``PAIRS_UP_TO`` members propose all pairs between different components.
   Larger buckets, which a group of many variants of one text makes, are searched exactly without listing their pairs.
   Each has a root R near their middle, and D(x) = x symmetric-difference R. For two texts |a diff b| = |D(a) diff D(b)|,
   so a link needs D(a) and D(b) to share (|D(a)| + |D(b)| - |a diff b|) / 2 elements, at least one unless both
   are linked with R. D holds a variant's own edits, rare things; with the elements rarest first, a prefix filter on
   D and the places of the elements that two prefixes share leave few candidates, and lose none. Roots whose members
   have become one component, and members whose prefix holds only elements of their own, drop out before.
4. Components by alternating large-star and small-star steps, cut off with written tables.

A pair of similarity s shares a band with probability 1 - (1 - s**rows)**bands: at 0.85 with 32 bands of 4 it is missed
once in 10**10, at 0.80 once in 2 * 10**7.

Edge cases: null text and a text without words have no shingles, are linked with nothing and kept; with fewer than
``shingle`` words the whole sequence is the only shingle; rows with null or equal doc_id are documents of their own, and
of a group the row with the smallest doc_id (nulls last; then by the text's hash) is kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._text import fresh, mix, slices, words
from quern.runtime import row_keys, small, stage, unique_ids

SHINGLE, BANDS, ROWS, PERCENT = 5, 32, 4, 80
BLOCK_BYTES = 4 << 20
#: Members up to which a bucket's pairs are listed; larger buckets go through the differences to a root.
PAIRS_UP_TO = 32

SEED = np.uint64(0x9E3779B97F4A7C15)


def step(i: int) -> np.uint64:
    return np.uint64(i * int(SEED) % 2**64)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
    """64-bit hashes of all shingles (repeats included), their text, shingles per text, a digest per text, words per text."""
    vocabulary, index, counts = words(texts)
    lists = vocabulary.to_pylist()
    hashes = np.frombuffer(b"".join(hashlib.blake2b(w.encode("utf-8", "surrogatepass"), digest_size=8).digest() for w in lists), dtype=np.uint64)
    token = hashes[index] if len(index) else np.zeros(0, dtype=np.uint64)
    begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
    per = np.where(counts == 0, 0, np.maximum(1, counts - k + 1))
    owner = np.repeat(np.arange(len(counts)), per)
    at = np.repeat(begin - np.concatenate(([0], np.cumsum(per)))[:-1], per) + np.arange(int(per.sum()))
    padded = np.concatenate((token, np.zeros(k, dtype=np.uint64)))
    width = np.minimum(counts, k)[owner]
    h = np.zeros(len(at), dtype=np.uint64)
    short = np.flatnonzero(width < k)
    for j in range(k):
        part = mix(padded[at + j] + step(j + 1))
        if len(short):
            part[short[width[short] <= j]] = 0
        h = (h * np.uint64(0x100000001B3)) ^ part
    h = mix(h + width.astype(np.uint64))
    # the digest covers the whole sequence of word hashes
    raw = token.tobytes()
    digests = [hashlib.blake2b(raw[8 * a : 8 * (a + n)], digest_size=16).digest() for a, n in zip(begin.tolist(), counts.tolist(), strict=True)]
    return h, owner, per, digests, counts


def sketch(h: np.ndarray, owner: np.ndarray, n: int, t: int) -> np.ndarray:
    """Fast similarity sketches of n sets as an (n, t) array; all ones for an empty set."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.full(n * t, empty, dtype=np.uint64)
    filled = np.zeros(n, dtype=np.int64)
    live_h, live_o = h, owner
    for i in range(2 * t):
        if not len(live_h):
            break
        x = mix(live_h + step(i + 1))
        bins = (x >> np.uint64(40)) % np.uint64(t) if i < t else np.full(len(x), i - t, dtype=np.uint64)
        value = (np.uint64(i) << np.uint64(40)) | (x & np.uint64((1 << 40) - 1))
        np.minimum.at(out, live_o * t + bins.astype(np.int64), value)
        filled = (out.reshape(n, t) != empty).sum(axis=1)
        keep = filled[live_o] < t
        live_h, live_o = live_h[keep], live_o[keep]
    return out.reshape(n, t)


def profile(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (two longs), bands (keys; null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, "text", BLOCK_BYTES):
            h, owner, per, digests, _ = shingles(batch.column("text"), k)
            n = batch.num_rows
            stops = np.cumsum(per)
            distinct = [len(np.unique(h[b - m : b])) for b, m in zip(stops.tolist(), per.tolist(), strict=True)]
            s = sketch(h, owner, n, bands * rows).reshape(n, bands, rows)
            keys = np.zeros((n, bands), dtype=np.uint64) + np.arange(1, bands + 1, dtype=np.uint64)[None, :] * SEED
            for r in range(rows):
                keys = mix(keys + s[:, :, r])
            pair = np.frombuffer(b"".join(digests), dtype=np.int64).reshape(n, 2)
            flat = pa.array(keys.view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat, mask=pa.array(per == 0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(distinct, pa.int64()), pa.array(pair[:, 0]), pa.array(pair[:, 1]), lists], names=["doc_id", "n_shingles", "d1", "d2", "bands"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, shingles: the sorted distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in slices(batches, "text", BLOCK_BYTES):
            h, _, per, _, _ = shingles(batch.column("text"), k)
            stops = np.cumsum(per)
            sets = [np.unique(h[b - m : b]).view(np.int64) for b, m in zip(stops.tolist(), per.tolist(), strict=True)]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) of all nodes of ``links`` (a, b): component is the least node reachable.

    Large-star and small-star steps alternate until the edges are stars; each step is written out.
    """
    edges = stage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    last = None
    for _ in range(most):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        starred = large.join(large.groupBy("u").agg(F.min("v").alias("m")), "u")
        joined = starred.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = stage(joined.unionByName(starred.select("u", F.col("m").alias("v"))).distinct())
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
    else:
        raise RuntimeError("components did not settle")
    nodes = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return stage(nodes.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")))


def near_duplicates(
    docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, pairs_up_to: int = PAIRS_UP_TO
) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (its first row's doc_id), kept."""
    if unique_ids(docs):
        return near_rows(docs, k, bands, rows, percent, pairs_up_to)
    keyed = row_keys(docs.select("doc_id", "text"), "key")
    found = near_rows(keyed.select(F.col("key").alias("doc_id"), "text"), k, bands, rows, percent, pairs_up_to).withColumnRenamed("doc_id", "key")
    names = keyed.select("key", "doc_id")
    first = found.join(names.select(F.col("key").alias("component_id"), F.col("doc_id").alias("first")), "component_id", "left")
    return first.join(names, "key").select("doc_id", "n_shingles", F.col("first").alias("component_id"), "kept")


def near_rows(docs: DataFrame, k: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, percent: int = PERCENT, pairs_up_to: int = PAIRS_UP_TO) -> DataFrame:
    """``near_duplicates`` of rows whose doc_id is a key (long, no nulls)."""
    sketches = stage(profile(docs, k, bands, rows))
    real = sketches.filter("n_shingles > 0")
    classes = real.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    copies = stage(classes.filter("copies > 1").select("d1", "d2", "rep"))
    member = stage(real.select("doc_id", "d1", "d2").join(small(copies), ["d1", "d2"]).select("doc_id", "rep"))
    reps = real.join(small(member.filter("doc_id <> rep").select("doc_id")), "doc_id", "left_anti")
    at = reps.select("doc_id", F.explode("bands").alias("key"))
    full = at.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    buckets = stage(at.join(full, "key"))
    sharing = buckets.groupBy("doc_id").agg(F.sum("n").alias("weight"))
    buckets = stage(buckets.select("key", "doc_id").join(sharing, "doc_id"))
    wanted = sharing.select("doc_id")
    sets = stage(shingle_sets(docs.join(small(wanted), "doc_id", "left_semi"), k))
    lengths = stage(sets.select("doc_id", F.size("shingles").alias("n")))

    def verified(pairs: DataFrame) -> DataFrame:
        """pairs (a, b) with a flag whether they are linked; sizes that rule a link out are not compared."""
        na, nb = lengths.select(F.col("doc_id").alias("a"), F.col("n").alias("na")), lengths.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"))
        sized = pairs.join(small(na), "a").join(small(nb), "b")
        near = sized.filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent).select("a", "b", "na", "nb")
        left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
        both = near.join(right, "b").join(left, "a")
        shared = F.size(F.array_intersect("sa", "sb"))
        return both.filter(shared * 100 >= (F.col("na") + F.col("nb") - shared) * percent).select("a", "b")

    def joined_by(found: DataFrame, links: DataFrame | None, comp: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        if links is None or found.limit(1).count():
            links = found if links is None else links.unionByName(found)
            comp = components(links)
        return links, comp

    def mixed(comp: DataFrame) -> DataFrame:
        """Bucket rows with components, of buckets that hold two components or more."""
        named = buckets.join(small(comp.select(F.col("node").alias("doc_id"), "component")), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        spread = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n")).filter("lo < hi")
        return named.join(small(stage(spread.select("key", "n"))), "key")

    # every bucket's centre with its members
    stars = buckets.groupBy("key").agg(F.max(F.struct("weight", (-F.col("doc_id")).alias("d"))).alias("c")).select("key", (-F.col("c.d")).alias("c"))
    pairs = buckets.join(small(stage(stars)), "key").filter("doc_id <> c").select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b"))
    tried = stage(pairs.distinct())
    links, comp = joined_by(stage(verified(tried)), None, None)
    # small buckets: all pairs between components
    rest = stage(mixed(comp))
    few = rest.filter(F.col("n") <= pairs_up_to)
    other = few.select("key", F.col("doc_id").alias("b"), F.col("component").alias("cb"))
    pairs = few.select("key", F.col("doc_id").alias("a"), "component").join(other, "key").filter("a < b and component <> cb").select("a", "b")
    found = stage(verified(stage(pairs.distinct().join(tried, ["a", "b"], "left_anti"))))
    links, comp = joined_by(found, links, comp)
    # large buckets: exactly, through the differences to a common root
    many = stage(mixed(comp).filter(F.col("n") > pairs_up_to))
    if many.limit(1).count():
        members = stage(_roots(many))
        found, pairs = _by_differences(members, sets, lambda f: joined_by(f, links, comp), percent)
        links, comp = found
        found = stage(verified(stage(pairs)))
        links, comp = joined_by(found, links, comp)
    rep = F.coalesce("rep", "doc_id")
    out = sketches.select("doc_id", "n_shingles").join(small(member), "doc_id", "left").withColumn("rep", rep)
    out = out.join(small(comp.select(F.col("node").alias("rep"), "component")), "rep", "left")
    top = F.coalesce("component", "rep")
    return out.select("doc_id", "n_shingles", top.alias("component_id"), (F.col("doc_id") == top).alias("kept"))


def _roots(many: DataFrame) -> DataFrame:
    """(root, doc_id) of the rows (key, doc_id, weight, ...) of large buckets: all members of a bucket have its root.

    A bucket's centre is its member of most weight; its root is found by going twice from a document to the heaviest centre
    among its buckets, so the many buckets of one group agree on one root, or a few.
    """
    heaviest = F.max(F.struct("weight", (-F.col("doc_id")).alias("d")))
    centres = small(stage(many.groupBy("key").agg(heaviest.alias("h")).select("key", "h", (-F.col("h.d")).alias("c"))))
    up = many.select("key", "doc_id").join(centres, "key").groupBy("doc_id").agg(F.max("h").alias("h")).select(F.col("doc_id").alias("c"), (-F.col("h.d")).alias("up"))
    once = centres.select("key", "c").join(up, "c").select("key", F.col("up").alias("c"))
    roots = once.join(up, "c").select("key", F.col("up").alias("root"))
    return many.select("key", "doc_id").join(small(stage(roots)), "key").select("root", "doc_id").distinct()


def _by_differences(members: DataFrame, sets: DataFrame, join, percent: int) -> tuple[tuple[DataFrame, DataFrame], DataFrame]:
    """Link members with their roots, then propose the pairs that may be linked: ((links, components), pairs)."""
    root = sets.select(F.col("doc_id").alias("root"), F.col("shingles").alias("sr"))
    both = members.join(sets, "doc_id").join(root, "root")
    mine, lost = F.array_except("shingles", "sr"), F.array_except("sr", "shingles")
    differ = stage(both.select("root", "doc_id", F.size("shingles").alias("n"), F.size("sr").alias("nr"), mine.alias("mine"), lost.alias("lost")).withColumn("nd", F.size("mine") + F.size("lost")))
    # similarity >= p is a difference of at most (n + m) (1 - p) / (1 + p)
    near = F.col("nd") * (100 + percent) <= (F.col("n") + F.col("nr")) * (100 - percent)
    found = stage(differ.filter(near & (F.col("doc_id") != F.col("root"))).select(F.least("doc_id", "root").alias("a"), F.greatest("doc_id", "root").alias("b")).distinct())
    links, comp = join(found)
    named = comp.select(F.col("node").alias("doc_id"), "component")
    of_root = comp.select(F.col("node").alias("root"), F.col("component").alias("rc"))
    rows = differ.filter("nd > 0").join(small(named), "doc_id", "left").join(small(of_root), "root", "left")
    rows = rows.withColumn("component", F.coalesce("component", "doc_id")).withColumn("rc", F.coalesce("rc", "root"))
    # elements that a partner in another component has to share at least
    inside = F.floor((F.col("nd") * (100 + percent) + (F.col("nr") - F.col("n")) * (100 - percent)) / (2 * (100 + percent))) + 1
    outside = F.col("nd") - F.floor(F.col("n") * (100 - percent) / percent)
    need = F.greatest(F.lit(1), F.when(F.col("component") == F.col("rc"), inside).otherwise(outside))
    rows = rows.withColumn("keep", F.col("nd") - need + 1).filter("keep > 0").drop("rc", "nr")
    # a root whose members are one component has no more to find
    split = rows.groupBy("root").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("root")
    rows = stage(rows.join(small(split), "root", "left_semi"))
    # an element that no other member has can't be shared, but takes its place in the prefix: who has ``keep`` of them has no link.
    # an element that the root lacks is in no member's ``lost``, so counting among ``mine`` is enough here
    owned = rows.select("root", "doc_id", F.explode("mine").alias("x")).groupBy("root", "x").agg(F.count("*").alias("df"), F.min("doc_id").alias("doc_id"))
    alone = owned.filter("df = 1").groupBy("root", "doc_id").agg(F.count("*").alias("alone"))
    rows = rows.join(alone, ["root", "doc_id"], "left").filter(F.col("keep") > F.coalesce("alone", F.lit(0)))
    rows = stage(rows.select("root", "doc_id", "component", "n", "nd", "keep", F.concat("mine", "lost").alias("d")))
    at = rows.select("root", "doc_id", "component", "n", "nd", "keep", F.explode("d").alias("x"))
    counts = stage(at.groupBy("root", "x").agg(F.count("*").alias("df")).filter("df > 1"))
    each = Window.partitionBy("root", "doc_id")
    ranked = at.join(small(counts), ["root", "x"]).withColumn("r", F.row_number().over(each.orderBy("df", "x"))).withColumn("shared", F.count("*").over(each))
    # the elements of this member alone take the first places of its prefix
    prefix = ranked.filter(F.col("r") <= F.col("keep") - (F.col("nd") - F.col("shared")))
    prefix = stage(prefix.select("root", "doc_id", "component", "n", "nd", "shared", "r", "x"))

    def side(c: str) -> DataFrame:
        return prefix.select("root", "x", F.col("doc_id").alias(c), *[F.col(old).alias(f"{new}{c}") for old, new in (("component", "c"), ("n", "n"), ("nd", "d"), ("shared", "s"), ("r", "r"))])

    most = (F.col("na") + F.col("nb")) * (100 - percent)
    close = (F.abs(F.col("da") - F.col("db")) * (100 + percent) <= most) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    enough = lambda shared: 2 * shared * (100 + percent) >= (F.col("da") + F.col("db")) * (100 + percent) - most
    # beside an element that both have, two differences share what lies before it in both and what lies behind it in both
    before, behind = F.least("ra", "rb") - 1, F.least(F.col("sa") - F.col("ra"), F.col("sb") - F.col("rb"))
    met = side("a").join(side("b"), ["root", "x"]).filter((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & close & enough(before + 1 + behind))
    # and what they share lies in both prefixes or behind the last element that the prefixes share
    sums = met.groupBy("root", "a", "b", "da", "db", "na", "nb").agg((F.count("*") + F.min(behind)).alias("room"))
    pairs = sums.filter(enough(F.col("room"))).select("a", "b").distinct()
    return (links, comp), pairs
