"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's bag holds the word itself and its character 3-, 4- and 5-grams between word marks, hashed into ``buckets``
vectors of ``dim`` numbers. A text is the average over the bags of its distinct words; a linear softmax over two classes
gives the score. Embeddings and softmax are trained jointly, in numpy, by full-batch gradient steps with momentum (plain steps move a
subword by how many texts show it, which keeps rare subwords from being learnt by heart): the averages are a sparse
matrix A, so the forward pass is A (E W) and the gradient of E is (A' d) W', both by sums over its entries.
Unseen misspellings and inflections share most of their character n-grams with words seen in training.

The classifier is fitted on a bounded sample of labelled rows, at most ``max_per_class`` texts of at most ``max_chars``
characters of each class, by a hash of doc_id. All texts are scored whole.

Edge cases: null and empty texts have an empty bag, which averages to 0, and get the score that the bias gives; without labelled rows of both classes every score is 0; rows with equal doc_id are
scored apart; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._text import mix, slices, word_codes, words

BUCKETS, DIM, MAX_PER_CLASS, MAX_CHARS, STEPS, RATE = 1 << 17, 8, 1500, 40_000, 120, 1.0
#: Zero vectors that every bag holds besides its subwords, so that a few words alone can't decide; the softmax's scale.
PADDING, SCALE, MOMENTUM = 600, 60.0, 0.9
BLOCK_BYTES = 8 << 20


def bags(texts: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Subword buckets of the distinct words, the word of each; and (text, word) pairs, each once."""
    vocabulary, index, counts = words(pc.utf8_lower(pc.fill_null(texts, "")))
    codes, owner, lengths = word_codes(vocabulary)
    x = mix(codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    found, who = [], []
    h = x
    for n in range(2, 6):
        if len(x) < n:
            break
        h = (h[:-1] * np.uint64(0x100000001B3)) ^ x[n - 1 :]
        if n >= 3:
            same = owner[n - 1 :] == owner[: len(h)]
            found.append((mix(h[same] + np.uint64(n)) >> np.uint64(20)).astype(np.int64) % buckets)
            who.append(owner[: len(h)][same])
    if len(lengths):
        # the whole word: a sum of its position-weighted codes
        begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        at = np.arange(len(codes)) - np.repeat(begin, lengths)
        whole = np.add.reduceat(mix(x + at.astype(np.uint64)), begin)
        found.append((mix(whole) >> np.uint64(20)).astype(np.int64) % buckets)
        who.append(np.arange(len(lengths)))
    text = np.repeat(np.arange(len(counts)), counts)
    pair = np.unique(text * max(1, len(vocabulary)) + index)
    grams = (np.concatenate(found), np.concatenate(who)) if found else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))
    return *grams, pair // max(1, len(vocabulary)), pair % max(1, len(vocabulary))


class Model:
    """embeddings (buckets x dim), weights (dim x 2), bias (2)."""

    def __init__(self, texts: list[str], toxic: np.ndarray, buckets: int, dim: int, steps: int, rate: float, seed: int = 3):
        n = len(texts)
        parts = []  # per part of the texts: its first text, the subwords text by text, how many each text has
        for a in range(0, n, 200):
            gram, word, text, pair_word = bags(pa.array(texts[a : a + 200], pa.string()), buckets)
            order = np.argsort(word, kind="stable")
            size = np.bincount(word, minlength=int(word.max(initial=-1)) + 1)
            begin = np.concatenate(([0], np.cumsum(size)))
            k = size[pair_word]
            stop = np.cumsum(k)
            col = gram[order][np.repeat(begin[pair_word] - (stop - k), k) + np.arange(int(stop[-1]) if len(stop) else 0)].astype(np.int32)
            parts.append((a, col, np.bincount(text, weights=k, minlength=len(texts[a : a + 200])).astype(np.int64)))
        rng = np.random.default_rng(seed)
        e, w, b = rng.normal(0, 0.01, (buckets, dim)), rng.normal(0, 1.0, (dim, 2)), np.zeros(2)
        y = np.stack([1 - toxic, toxic], axis=1).astype(np.float64)
        share = (y / (2 * np.maximum(y.sum(0), 1))).sum(1)  # both classes weigh the same
        moved = [np.zeros_like(x) for x in (e, w, b)]
        for _ in range(steps):
            v = SCALE * (e @ w)
            s = np.zeros(buckets)
            slope = np.zeros(2)
            for a, col, size in parts:
                z = np.tile(b, (len(size), 1))
                full = size > 0
                starts = (np.cumsum(size) - size)[full]
                for j in range(2):
                    if len(starts):
                        z[full, j] += np.add.reduceat(v[col, j], starts) / (size[full] + PADDING)
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                d = (p - y[a : a + len(size)]) * share[a : a + len(size), None]
                slope += d.sum(0)
                # the slopes of both classes are opposite, so one sum over the subwords serves both columns
                s += SCALE * np.bincount(col, weights=np.repeat(d[:, 1] / (size + PADDING), size), minlength=buckets)
            both = np.stack([-s, s], axis=1)
            grads = (both @ w.T, 0.1 * (e.T @ both), slope)
            for param, grad, last in zip((e, w, b), grads, moved, strict=True):
                last *= MOMENTUM
                last -= rate * grad
                param += last
        self.buckets, self.e, self.w, self.b = buckets, e.astype(np.float32), w, b
        self.margin = SCALE * (self.e @ (w[:, 1] - w[:, 0])).astype(np.float64)  # what one subword adds to the log odds
        self.bias = float(b[1] - b[0])

    def scores(self, texts: pa.Array) -> np.ndarray:
        gram, word, text, pair_word = bags(texts, self.buckets)
        many = int(word.max(initial=-1)) + 1
        sums, sizes = np.bincount(word, weights=self.margin[gram], minlength=many), np.bincount(word, minlength=many)
        n = len(texts)
        total = np.bincount(text, weights=sums[pair_word], minlength=n)
        size = np.bincount(text, weights=sizes[pair_word], minlength=n)
        z = total / (size + PADDING) + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(
    docs: DataFrame, labels: DataFrame, train: Column, max_per_class: int = MAX_PER_CLASS, max_chars: int = MAX_CHARS,
    buckets: int = BUCKETS, dim: int = DIM, steps: int = STEPS, rate: float = RATE,
) -> Model | None:
    """Learn from docs (doc_id, text) with labels (doc_id, toxic) where ``train`` (on doc_id) holds."""
    marked = labels.filter(train & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [marked.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(2 * max_per_class) for k in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most 4 * max_per_class rows
    texts = docs.select("doc_id", "text").filter(F.coalesce(F.length("text"), F.lit(0)).between(1, max_chars)).join(chosen, "doc_id")
    nth = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id", "text"))
    rows = sorted((tuple(r) for r in texts.withColumn("_n", nth).filter(F.col("_n") <= max_per_class).drop("_n").collect()), key=lambda r: (r[0], r[1]))
    toxic = np.array([r[2] for r in rows], dtype=np.float64)
    if not len(rows) or toxic.min() == toxic.max():
        return None
    return Model([r[1] for r in rows], toxic, buckets, dim, steps, rate)


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text, ...) with score and predicted (1 if score >= 0.5), in place of columns of these names."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    names = [*docs.columns, "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in slices(batches, "text", BLOCK_BYTES):
            s = m.scores(batch.column("text")) if m else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, score double, predicted int")
