"""Scoring texts by a hidden Markov language model.

Tokens are the words of a text (A-Z lowered) and one end token. A state emits a word in two steps, the word's form class
(a hash of its first and last two letters and its length, ``CLASSES`` of them, and one for the end token) and then the
word: b_k(w) = P(class | k) * (c(w) + a) / (C_class + a * (V_class + 1)) with a = 0.1, c the word's training count, C and
V the training tokens and distinct words of the class; every class keeps one share for words not seen in training, as the
base model does for the whole vocabulary. The second factor doesn't depend on the state, so

    log P(text) = log P(classes), by the scaled forward recursion, + sum of log P(word | class)

is the exact likelihood of the text under the model. Transition, start and class probabilities come from Baum-Welch:
each round's expected counts are summed over all partitions.

Plan:
1. One pass over the texts cuts them into blocks of a bounded number of tokens and writes, per document, its tokens as
   numbers in the block's own vocabulary and their classes, and, per distinct word of a block, its training count.
2. One shuffle by word sums the counts over all blocks; another brings them back to the blocks. The vocabulary, which
   grows with the corpus, is never in one place.
3. Baum-Welch reads the classes only: ``WARM`` rounds on disjoint tenths of the training documents to part the states,
   then ``FULL`` rounds on all of them. What reaches the driver is the model (states x classes).
4. Each block's documents meet its counts and are scored.

Edge cases: a null or empty text is the end token alone; with no training documents all words are unknown and the
states are uniform; rows with equal doc_id are scored apart (train_tokens counts each row); an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._text import slices, trim, words
from quern.runtime import stage

STATES, CLASSES, WARM, FULL, ALPHA = 8, 2048, 6, 2, 0.1
#: Text bytes of a block and of a piece that is tokenised at once, documents in a written batch, tokens whose forward variables
#: are held at once, tokens that are sorted by length together.
BLOCK_BYTES, PIECE_BYTES, ROWS, LATTICE, GATHER = 20 << 20, 4 << 20, 2_000, 500_000, 4_000_000

DOC_SCHEMA = "block long, doc_id long, part int, tokens binary, classes binary, word string, number int, class int, n long"


def classes_of(vocabulary: pa.Array, classes: int) -> np.ndarray:
    """The form class of each word, 1 to classes; 0 is the end token's."""
    import zlib

    length = pc.min_element_wise(pc.utf8_length(vocabulary), pa.scalar(6, pa.int32())).cast(pa.string())
    forms = pc.binary_join_element_wise(pc.utf8_slice_codeunits(vocabulary, 0, 2), pc.utf8_slice_codeunits(vocabulary, -2), length, " ").dictionary_encode()
    codes = np.array([zlib.crc32(x.encode("utf-8", "surrogatepass")) % classes + 1 for x in forms.dictionary.to_pylist()], dtype=np.int64)
    return codes[forms.indices.to_numpy(zero_copy_only=False)] if len(forms) else np.zeros(0, dtype=np.int64)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]]:
    """Documents (doc_id, part) of about BLOCK_BYTES of text, their distinct words, the number of each token's word, and each one's tokens.

    A piece of PIECE_BYTES is tokenised as it comes, so only word numbers are held for a whole block.
    """
    rows, coded, counts, size = [], [], [], 0

    def block() -> tuple[pa.Table, pa.Array, np.ndarray, np.ndarray]:
        chunks = pa.chunked_array(coded).unify_dictionaries().chunks
        return pa.Table.from_batches(rows), chunks[0].dictionary, np.concatenate([c.indices.to_numpy() for c in chunks]), np.concatenate(counts)

    for piece in slices(batches, "text", PIECE_BYTES):
        text = piece.column("text")
        own = pc.sum(pc.binary_length(text)).as_py() or 0
        if rows and size + own > BLOCK_BYTES:
            yield block()
            rows, coded, counts, size = [], [], [], 0
        vocabulary, index, count = words(text)
        # copies, so that the batch with its texts goes
        rows.append(pa.record_batch([piece.column(c).take(pa.array(np.arange(piece.num_rows))) for c in ("doc_id", "part")], names=["doc_id", "part"]))
        coded.append(pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), vocabulary))
        counts.append(count)
        size += own
    if rows:
        yield block()


def written(block: int, docs: pa.Table, vocabulary: pa.Array, index: np.ndarray, counts: np.ndarray, classes: int) -> Iterator[pa.RecordBatch]:
    """The rows of a block: its documents, then its vocabulary with training counts."""
    part, doc_id = (docs.column(c).combine_chunks() for c in ("part", "doc_id"))
    cls, trained = classes_of(vocabulary, classes), np.zeros(len(vocabulary), np.int64)
    coded, learn = cls.astype("<u2"), part.to_numpy(zero_copy_only=False) != 0
    stops = np.cumsum(counts)
    for a in range(0, len(counts), ROWS):
        own, first = counts[a : a + ROWS], int(stops[a] - counts[a])
        tokens = index[first : first + int(own.sum())]
        trained += np.bincount(tokens[np.repeat(learn[a : a + ROWS], own)], minlength=len(vocabulary))
        ends = np.concatenate(([0], np.cumsum(own)))
        yield _rows(
            block, len(own), doc_id.slice(a, len(own)), part.slice(a, len(own)), _binary(tokens.astype("<i4"), ends), _binary(coded[tokens], ends)
        )
    for a in range(0, len(vocabulary), 20_000):
        k = min(20_000, len(vocabulary) - a)
        yield _rows(block, k, word=vocabulary.slice(a, k), number=pa.array(np.arange(a, a + k), pa.int32()), cls=pa.array(cls[a : a + k], pa.int32()), n=pa.array(trained[a : a + k], pa.int64()))


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of the values between each two ends, as one binary array."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


def blocks(docs: DataFrame, classes: int) -> DataFrame:
    """Rows of documents (word null) and of block vocabularies (doc_id null), block by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 32
        for docs in gathered(batches):
            yield from written(block, *docs, classes)
            del docs
            trim()
            block += 1

    return docs.mapInArrow(run, DOC_SCHEMA)


def _rows(block, length, doc_id=None, part=None, tokens=None, classes=None, word=None, number=None, cls=None, n=None) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.int32(), pa.int64())
    given = (doc_id, part, tokens, classes, word, number, cls, n)
    columns = [pa.nulls(length, t) if x is None else x.cast(t) for x, t in zip(given, types, strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(length, block, dtype=np.int64)), *columns], names=["block", "doc_id", "part", "tokens", "classes", "word", "number", "class", "n"])


class Model:
    """start (K), move (K x K) and emit (K x classes + 1) probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def first(cls, states: int, share: np.ndarray, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        emit = (share + 1e-4 / len(share)) * rng.gamma(4.0, 0.25, (states, len(share)))
        emit[:, 0] = share[0] + 1e-9
        move = np.full((states, states), 0.02 / max(1, states - 1)) + np.eye(states) * 0.98
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))


def lattice(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts by falling length: their order; all class codes, end code last, place by place (all first tokens, then all
    second ones, ...); and how many texts have a token at each place.

    The texts that have a token at a place are the first ones, so every step of a recursion works on slices.
    """
    lengths = np.array([len(c) + 1 for c in classes], dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    sorted_ = lengths[order]
    live = np.searchsorted(-sorted_, -np.arange(int(sorted_[0]) if len(sorted_) else 0), side="left")
    begin = np.concatenate(([0], np.cumsum(live)))
    flat = np.zeros(int(lengths.sum()), dtype=np.int64)
    for rank, i in enumerate(order.tolist()):
        flat[begin[: len(classes[i])] + rank] = classes[i]
    return order, flat, live


def forward(model: Model, flat: np.ndarray, live: np.ndarray, keep: bool) -> tuple[np.ndarray, np.ndarray | None, np.ndarray | None, np.ndarray]:
    """Log likelihoods of the texts; with ``keep`` the scaled forward variables and emission probabilities of all tokens;
    the scales."""
    kind = np.float32 if keep else np.float64
    b = np.ascontiguousarray(model.emit.T, dtype=kind)[flat]
    alphas = np.empty_like(b) if keep else b
    scales = np.empty(len(flat), dtype=kind)
    move, start = model.move.astype(kind), model.start.astype(kind)
    s, before = 0, None
    for n in live.tolist():
        alpha, scale = alphas[s : s + n], scales[s : s + n]
        if before is None:
            np.multiply(start, b[:n], out=alpha)
        else:
            np.multiply(before[:n] @ move, b[s : s + n], out=alpha)
        np.sum(alpha, axis=1, out=scale)
        alpha /= scale[:, None]
        s, before = s + n, alpha
    rank = np.arange(len(flat)) - np.repeat(np.cumsum(live) - live, live)
    logs = np.bincount(rank, weights=np.log(scales), minlength=int(live[0]) if len(live) else 0)
    return logs, alphas if keep else None, b if keep else None, scales


def expected(model: Model, flat: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch's expected counts of starts, moves and emissions, and the log likelihood."""
    logs, alphas, x, scales = forward(model, flat, live, True)
    states, width = model.emit.shape
    back = np.ascontiguousarray(model.move.T, dtype=np.float32)
    gamma = np.empty_like(alphas)
    stop, after, ends = len(flat), None, 0
    for n in live[::-1].tolist():
        s = stop - n
        beta = np.ones((n, states), dtype=np.float32)
        if ends:
            np.matmul(x[stop : stop + ends], back, out=beta[:ends])
        np.multiply(alphas[s:stop], beta, out=gamma[s:stop])
        # what the place before needs: emission times backward variable over scale
        here = x[s:stop]
        here *= beta
        here /= scales[s:stop, None]
        stop, ends = s, n
    first = int(live[0]) if len(live) else 0
    move = np.zeros((states, states))
    # each token after the first place, and the token before it
    previous = np.arange(first, len(flat)) - np.repeat(live[:-1], live[1:]) if len(live) > 1 else np.zeros(0, dtype=np.int64)
    for a in range(0, len(previous), 100_000):
        move += alphas[previous[a : a + 100_000]].T.astype(np.float64) @ x[first + a : first + a + 100_000]
    counts = np.stack([np.bincount(flat, weights=gamma[:, j], minlength=width) for j in range(states)])
    return gamma[:first].sum(0, dtype=np.float64), move * model.move, counts, float(logs.sum())


def _groups(codes: list[np.ndarray]) -> Iterator[list[int]]:
    """Texts in groups of about LATTICE tokens, of like length each."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    group, total = [], 0
    for i in order:
        group.append(i)
        total += len(codes[i]) + 1
        if total >= LATTICE:
            yield group
            group, total = [], 0
    if group:
        yield group


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Class codes of the texts of several batches together, GATHER tokens or so, for groups of like length."""
    codes, total = [], 0
    for batch in slices(batches, "classes", 2 * GATHER):
        codes += [np.frombuffer(x, dtype="<u2") for x in batch.column("classes").to_pylist()]
        total += sum(map(len, codes[-batch.num_rows :]))
        if total >= GATHER:
            yield codes
            codes, total = [], 0
    if codes:
        yield codes


def baum_welch(rows: DataFrame, share: np.ndarray, states: int, warm: int, full: int) -> Model:
    """Fit on the training rows (part > 0; classes): warm rounds take one part each, the others all."""
    spark = rows.sparkSession
    model = Model.first(states, share)
    width = len(share)
    for step in range(warm + full):
        sent = spark.sparkContext.broadcast((model.start, model.move, model.emit))

        def count(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = Model(*sent.value)
            sums: list[np.ndarray] | None = None
            for codes in _gathered(batches):
                for group in _groups(codes):
                    got = expected(m, *lattice([codes[i] for i in group])[1:])
                    sums = list(got[:3]) if sums is None else [a + b for a, b in zip(sums, got[:3], strict=True)]
            trim()
            if sums is not None:
                flat = np.concatenate([x.ravel() for x in sums])
                cell = np.flatnonzero(flat > 0)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(flat[cell])], names=["cell", "value"])

        chosen = rows.filter(F.col("part") == step % 9 + 1) if step < warm else rows.filter("part > 0")
        cells = chosen.select("classes").mapInArrow(count, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toPandas()
        sums = np.zeros(states + states * states + states * width)
        sums[cells["cell"].to_numpy()] = cells["value"].to_numpy()
        start, move, emit = sums[:states], sums[states : states + states**2].reshape(states, states), sums[states + states**2 :].reshape(states, width)
        start, move = start + 1e-3, move + 1e-3
        emit = emit + 5.0 * share + 1e-6
        model = Model(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))
        sent.unpersist()
    return model


def score(
    docs: DataFrame, part, states: int = STATES, classes: int = CLASSES, warm: int = WARM, full: int = FULL, alpha: float = ALPHA
) -> DataFrame:
    """doc_id, part, n_tokens, n_known, train_tokens, base_score, score (log10) for docs (doc_id, text).

    ``part`` is a column expression 0 to 9: 0 is held out, 1 to 9 are the training documents.
    """
    rows = stage(blocks(docs.select("doc_id", "text", part.cast("int").alias("part")), classes))
    vocabulary = rows.filter(F.col("word").isNotNull()).select("block", "number", "word", "class", "n")
    # counts over all blocks, back in the blocks: one row per block
    summed = vocabulary.repartition("word").sortWithinPartitions("word")

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches are sorted by word, so each word's rows are adjacent; an open word waits for the next batch."""
        open_: pa.Table | None = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if open_ is None else pa.concat_tables([open_, t]).combine_chunks()
            w = t.column("word").combine_chunks()
            change = np.flatnonzero(pc.not_equal(w[1:], w[:-1]).to_numpy(zero_copy_only=False)) + 1 if len(w) > 1 else np.zeros(0, dtype=np.int64)
            if not len(change):
                open_ = t
                continue
            open_ = t.slice(change[-1])
            yield summed_rows(t.slice(0, change[-1]), change)
        if open_ is not None and open_.num_rows:
            w = open_.column("word")
            yield summed_rows(open_, np.array([open_.num_rows]))
        trim()

    def summed_rows(t: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        begin = np.concatenate(([0], ends[:-1]))
        c = np.add.reduceat(t.column("n").to_numpy(), begin)
        per = np.diff(np.concatenate((begin, [t.num_rows])))
        first = np.zeros(t.num_rows, dtype=bool)
        first[begin[c > 0]] = True
        return pa.RecordBatch.from_arrays(
            [t.column("block").combine_chunks(), t.column("number").combine_chunks(), t.column("class").combine_chunks(), pa.array(np.repeat(c, per)), pa.array(first)],
            names=["block", "number", "class", "c", "first"],
        )

    counted = summed.select("block", "number", "word", "class", "n").mapInArrow(total, "block long, number int, class int, c long, first boolean")

    def gather(table: pa.Table) -> pa.Table:
        number = table.column("number").to_numpy()
        c, cls, first = (np.empty(len(number), dtype=d) for d in ("<i8", "<u2", "u1"))
        c[number], cls[number], first[number] = table.column("c").to_numpy(), table.column("class").to_numpy(), table.column("first").to_numpy(zero_copy_only=False)
        kinds = np.bincount(cls[first == 1], minlength=classes + 1).astype("<i8")
        return pa.table({"block": table.column("block").slice(0, 1), "c": pa.array([c.tobytes()], pa.binary()), "cls": pa.array([cls.tobytes()], pa.binary()), "kinds": pa.array([kinds.tobytes()], pa.binary())})

    counts = stage(counted.groupBy("block").applyInArrow(gather, "block long, c binary, cls binary, kinds binary"))
    texts = rows.filter(F.col("word").isNull())
    # training tokens and distinct words of each class, end tokens included
    in_class = vocabulary.groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    tokens = np.zeros(classes + 1)
    tokens[in_class["class"].to_numpy(dtype=np.int64)] = in_class["n"].to_numpy(dtype=np.float64)
    tokens[0] = texts.filter("part > 0").count()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(classes + 1, dtype=np.int64)
        for batch in batches:
            for x in batch.column("kinds").to_pylist():
                sums += np.frombuffer(x, dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes + 1), pa.int32()), pa.array(sums)], names=["class", "kinds"])

    kinds_in = counts.select("kinds").mapInArrow(add, "class int, kinds long").groupBy("class").agg(F.sum("kinds").alias("kinds")).toPandas()
    kinds = np.zeros(classes + 1)
    kinds[kinds_in["class"].to_numpy(dtype=np.int64)] = kinds_in["kinds"].to_numpy(dtype=np.float64)
    kinds[0] = float(tokens[0] > 0)
    n_train, n_kinds = float(tokens.sum()), float(kinds.sum())
    share = (tokens + ALPHA) / (n_train + ALPHA * (classes + 1))
    model = baum_welch(texts.select("part", "classes"), share, states, warm, full)
    sent = docs.sparkSession.sparkContext.broadcast((model.start, model.move, model.emit, tokens, kinds))
    base_of_end = float(np.log10((tokens[0] + alpha) / (n_train + alpha * (n_kinds + 1))))

    def scored(key, documents: pa.Table, block: pa.Table) -> pa.Table:
        start, move, emit, in_, of = sent.value
        m = Model(start, move, emit)
        if block.num_rows:
            c, cls = np.frombuffer(block.column("c")[0].as_py(), dtype="<i8"), np.frombuffer(block.column("cls")[0].as_py(), dtype="<u2")
        else:
            c, cls = np.zeros(0, dtype="<i8"), np.zeros(0, dtype="<u2")
        base = np.log10((c + alpha) / (n_train + alpha * (n_kinds + 1)))
        inside = np.log10((c + alpha) / (in_[cls] + alpha * (of[cls] + 1)))
        tokens_of = [np.frombuffer(x, dtype="<i4") for x in documents.column("tokens").to_pylist()]
        logs = np.zeros(len(tokens_of))
        codes = [cls[t] for t in tokens_of]
        for group in _groups(codes):
            order, flat, live = lattice([codes[i] for i in group])
            logs[np.array(group)[order]] = forward(m, flat, live, False)[0] / np.log(10)
        sums = np.array([(len(t) + 1, (c[t] > 0).sum() + (in_[0] > 0), base[t].sum() + base_of_end, inside[t].sum()) for t in tokens_of]).reshape(-1, 4)
        return pa.table({
            "doc_id": documents.column("doc_id"), "part": documents.column("part"),
            "n_tokens": pa.array(sums[:, 0].astype(np.int64)), "n_known": pa.array(sums[:, 1].astype(np.int64)),
            "train_tokens": pa.array(np.full(len(sums), int(n_train), dtype=np.int64)),
            "base_score": pa.array(sums[:, 2]), "score": pa.array(sums[:, 3] + logs),
        })

    left = texts.select("block", "doc_id", "part", "tokens").groupBy("block")
    schema = "doc_id long, part int, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return left.cogroup(counts.select("block", "c", "cls").groupBy("block")).applyInArrow(scored, schema)
