"""Exact nearest neighbours by cosine: a block matrix join of int8 tiles with error bounds.

Vectors are scaled to unit length and stored as int8 codes with one scale each and the exact norm of the rounding error.
Queries and candidates are cut into blocks; a tile is the product of some queries and a candidate block over the codes,
summed over at most 1,024 dimensions at a time (whole numbers below 2**24, so a float32 product is exact) and then in
double precision, so the bound holds for vectors of any length. With |q - q'| <= e_q and |c - c'| <= e_c the true cosine lies
within e_q + e_c + e_q e_c of the tile's value. A query's k-th largest lower bound in the tile, and the k-th best score
its heap already holds, rule out all candidates whose upper bound is smaller; the others are computed in double precision
on the original vectors, scaled by a power of two, and go through the query's heap. A last step merges the heaps of all
tasks.

Tiles are dealt out by query block and group of candidate blocks: a task holds one query block and a few candidate
blocks, and its heaps pass over them. Blocks have a size in bytes, so a task's memory doesn't depend on the table or
the vectors' length. What is moved is each candidate once per query block and each query once per group.

Edge cases: vectors that are null, zero, or hold null or non-finite numbers take no part, neither as queries nor as
candidates; only vectors of equal length are compared; equal vec_ids are rows of their own, and a query's own id is no
candidate; ties go to the smaller vec_id; a query with fewer candidates than k gets them all, without any it has no row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.runtime import partitions, small, stage

#: Bytes of vectors in a block of queries and of candidates, and neighbours of each query.
QUERY_BYTES, CANDIDATE_BYTES, EACH = 8 << 20, 2 << 20, 5
#: Candidate blocks, on average, that one task holds beside a query block, where there are more than tasks.
TOGETHER = 16
#: Queries in a tile, and dimensions whose code products are summed in float32.
ROWS, EXACT = 256, 1024


def usable(vector: str) -> Column:
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def packed(vectors: DataFrame, block_bytes: int) -> DataFrame:
    """Blocks of vectors of one length, of at most ``block_bytes`` or one vector: block, dim, ids and vectors as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 20
        waiting: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def out(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids = np.concatenate([x[0] for x in waiting[dim]])
            data = np.concatenate([x[1] for x in waiting[dim]])
            waiting[dim] = []
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([number - 1], pa.int64()), pa.array([dim], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([data.astype("<f8").tobytes()], pa.binary())], names=["block", "dim", "ids", "vectors"])

        for batch in batches:
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            lists = batch.column("embedding")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False).astype(np.float64)
            begin = lists.offsets.to_numpy()[:-1]
            for dim in np.unique(sizes):
                rows = np.flatnonzero(sizes == dim)
                block = max(1, block_bytes // (8 * int(dim)))
                data = values[begin[rows][:, None] + np.arange(dim)]
                for a in range(0, len(rows), block):
                    part = rows[a : a + block]
                    have = sum(len(x[0]) for x in waiting.get(int(dim), []))
                    if have + len(part) > block:
                        yield out(int(dim))
                    waiting.setdefault(int(dim), []).append((ids[part], data[a : a + block]))
        for dim in [d for d, x in waiting.items() if x]:
            yield out(dim)

    return vectors.mapInArrow(run, "block long, dim int, ids binary, vectors binary")


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit vectors, their scales, and the norm of what rounding lost (a little more, for the arithmetic)."""
    unit = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    unit = unit / np.sqrt((unit * unit).sum(1, keepdims=True))
    scale = np.abs(unit).max(1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = unit - codes * scale[:, None]
    return codes, scale, np.sqrt((lost * lost).sum(1)) + 1e-9


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of each row pair in double precision; equal rows give equal bits wherever they stand.

    Rows are scaled by a power of two first, which changes no digit but keeps squares in range.
    """
    q, c = (np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1]) for x in (q, c))
    return (q * c).sum(1) / (np.sqrt((q * q).sum(1)) * np.sqrt((c * c).sum(1)))


def tile(queries: tuple, candidates: tuple, k: int, heaps: dict[tuple[int, int], list]) -> None:
    """Put what may be among the k nearest of each query into its heap of (score, -vec_id)."""
    row_of, q_ids, q, q_codes, q_scale, q_lost = queries
    c_ids, c, c_codes, c_scale, c_lost = candidates
    dot = np.zeros((len(q_codes), len(c_codes)))
    for a in range(0, q_codes.shape[1], EXACT):
        dot += q_codes[:, a : a + EXACT].astype(np.float32) @ c_codes[:, a : a + EXACT].astype(np.float32).T
    near = dot * q_scale[:, None] * c_scale[None, :]
    slack = q_lost[:, None] + c_lost[None, :] + q_lost[:, None] * c_lost[None, :]
    own = q_ids[:, None] == c_ids[None, :]
    low = np.where(own, -np.inf, near - slack)
    floor = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(q_ids), -np.inf)
    held = np.array([heaps[(int(i), int(r))][0][0] if len(heaps.get((int(i), int(r)), ())) == k else -np.inf for i, r in zip(q_ids, row_of, strict=True)])
    rows, cols = np.nonzero((near + slack >= np.maximum(floor, held)[:, None]) & ~own)
    exact = np.concatenate([np.zeros(0), *(cosines(q[rows[a : a + 50_000]], c[cols[a : a + 50_000]]) for a in range(0, len(rows), 50_000))])
    if len(rows):
        order = np.lexsort((c_ids[cols], -exact, rows))
        r = rows[order]
        begin = np.maximum.accumulate(np.where(np.diff(r, prepend=-1) != 0, np.arange(len(r)), 0))
        order = order[np.arange(len(r)) - begin < k]
        for i, value, other in zip(rows[order].tolist(), exact[order].tolist(), c_ids[cols[order]].tolist(), strict=True):
            heap = heaps.setdefault((int(q_ids[i]), int(row_of[i])), [])
            if len(heap) < k:
                heapq.heappush(heap, (value, -other))
            elif (value, -other) > heap[0]:
                heapq.heapreplace(heap, (value, -other))


def nearest(vectors: DataFrame, is_query: Column, k: int = EACH, query_bytes: int = QUERY_BYTES, candidate_bytes: int = CANDIDATE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query among all other rows of vectors (vec_id, embedding)."""
    spark = vectors.sparkSession
    clean = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter(F.col("vec_id").isNotNull() & usable("embedding"))
    asked = clean.filter(is_query)
    # as few tasks as fill a query block each
    size = asked.agg(F.coalesce(F.sum(F.size("embedding").cast("long") * 8), F.lit(0)).alias("b")).first()["b"]
    queries = stage(packed(asked.repartition(max(1, -(-size // query_bytes))), query_bytes))
    candidates = stage(packed(clean, candidate_bytes))
    # every candidate block meets every query block of its dimension: a stated query set against all rows
    n = candidates.count()
    groups = max(1, min(n, partitions(spark)), n // TOGETHER)
    dims = small(queries.select("dim", F.col("block").alias("q_block")))
    c = candidates.join(dims, "dim").withColumn("part", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    q = queries.select(F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "dim", "ids", "vectors")
    c = c.select(F.col("q_block").alias("c_q_block"), F.col("part").alias("c_part"), "block", "ids", "vectors")

    def vectors_of(table: pa.Table, i: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(table.column("ids")[i].as_py(), "<i8"), np.frombuffer(table.column("vectors")[i].as_py(), "<f8").reshape(-1, dim)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        heaps: dict[tuple[int, int], list] = {}
        if left.num_rows and right.num_rows:
            dim, q_block = left.column("dim")[0].as_py(), left.column("q_block")[0].as_py()
            ids, x = vectors_of(left, 0, dim)
            codes = quantised(x)
            # (block, place) tells rows with equal vec_id apart
            number = (q_block << 21) + np.arange(len(ids))
            for i in np.argsort(right.column("block").to_numpy()).tolist():
                c_ids, c_x = vectors_of(right, i, dim)
                candidate = (c_ids, c_x, *quantised(c_x))
                for a in range(0, len(ids), ROWS):
                    s = slice(a, a + ROWS)
                    tile((number[s], ids[s], x[s], *(y[s] for y in codes)), candidate, k, heaps)
        rows = [(q, r, -i, s) for (q, r), heap in heaps.items() for s, i in heap]
        cols = list(zip(*rows, strict=True)) if rows else [(), (), (), ()]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "query_row": pa.array(cols[1], pa.int64()), "vec_id": pa.array(cols[2], pa.int64()), "score": pa.array(cols[3], pa.float64())})

    best = q.groupBy("q_block", "part").cogroup(c.groupBy("c_q_block", "c_part")).applyInArrow(run, "query_id long, query_row long, vec_id long, score double")
    order = Window.partitionBy("query_id", "query_row").orderBy(F.desc("score"), "vec_id")
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
