"""Language identification with string kernels.

Kernel: a text is the set of its character 1-, 2- and 3-grams (blended spectrum, presence only) over lower-case letters,
with every run of other characters as one space; the kernel of two texts is the cosine of their sets. Grams that no
landmark has meet none, so a text's set is taken within the landmarks' grams, which is a kernel of the same kind.

Model: landmarks are training texts; Nystroem features are K(x, landmarks) K(landmarks, landmarks)^(-1/2), and one ridge
regression per language, one versus rest, is solved on them. Scoring a batch is two matrix products: presence x
landmarks, and kernel values x coefficients. The score is the largest response, cut to 0..1; a text unlike every training
text has responses near 0.

The classifier is fitted on a bounded sample: at most ``max_train`` labelled texts of at most ``max_chars`` characters,
shared evenly by the languages, ``max_landmarks`` of them landmarks; the sample follows a hash of doc_id. All texts are
scored whole.

Edge cases: null text or no letter gives ``und`` and score 0; without any labelled text every text is ``und``; ties of
responses go to the language first in code-point order; rows with equal doc_id are scored apart; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._text import fresh, slices
from quern.runtime import small, stage

MAX_TRAIN, MAX_LANDMARKS, MAX_CHARS, RIDGE, ALPHABET = 2400, 192, 20_000, 0.01, 160
UNDETERMINED = "und"
#: Bytes of text and texts per matrix product.
BLOCK_BYTES, BLOCK_TEXTS = 2 << 20, 256

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() for i in range(0x110000)]))
    return _letters[0]


def symbols(texts: pa.Array, alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters as numbers from 1 (1: not in the alphabet), runs of others as 0; the text of each; which texts have letters."""
    lower = pc.utf8_lower(pc.fill_null(texts, ""))
    n = len(lower)
    sizes = pc.utf8_length(lower).to_numpy(zero_copy_only=False).astype(np.int64)
    codes = np.frombuffer("".join(lower.to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    is_letter = letters()[codes]
    has = np.zeros(n, dtype=bool)
    has[owner[is_letter]] = True
    sym = np.where(is_letter, alphabet[codes], 0)
    keep = np.ones(len(sym), dtype=bool)
    if len(sym) > 1:
        keep[1:] = (sym[1:] != 0) | (sym[:-1] != 0) | (owner[1:] != owner[:-1])
    return sym[keep].astype(np.int64), owner[keep], has


def grams(sym: np.ndarray, owner: np.ndarray, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Codes of the 1-, 2- and 3-grams (each order in a range of its own) and their texts."""
    yield sym, owner
    if len(sym) > 1:
        same = owner[1:] == owner[:-1]
        yield (sym[:-1] * width + sym[1:])[same] + width, owner[1:][same]
    if len(sym) > 2:
        same = owner[2:] == owner[:-2]
        yield ((sym[:-2] * width + sym[1:-1]) * width + sym[2:])[same] + width + width * width, owner[2:][same]


class Model:
    """What the executors need: the alphabet, the number of each landmark gram, landmarks and coefficients."""

    def __init__(self, texts: list[str], labels: list[str], n_landmarks: int, ridge: float, alphabet: int):
        self.languages = sorted(set(labels))
        chars, n = np.unique(np.frombuffer("".join(pc.utf8_lower(pa.array(texts, pa.string())).to_pylist()).encode("utf-32-le", "surrogatepass"), dtype=np.uint32), return_counts=True)
        known = letters()[chars]
        common = chars[known][np.argsort(-n[known], kind="stable")][:alphabet]
        self.symbol = np.ones(0x110000, dtype=np.uint8)
        self.symbol[common] = np.arange(2, 2 + len(common))
        self.width = len(common) + 2
        space = self.width + self.width**2 + self.width**3
        # landmarks are spread evenly over the languages: the sample alternates between them
        marks = list(range(min(n_landmarks, len(texts))))
        seen = np.zeros(space, dtype=bool)
        for sym, owner, _ in [symbols(pa.array([texts[i] for i in marks], pa.string()), self.symbol)]:
            for code, _ in grams(sym, owner, self.width):
                seen[code] = True
        self.number = np.full(space, -1, dtype=np.int32)
        self.number[seen] = np.arange(int(seen.sum()))
        self.size = int(seen.sum())
        self.landmarks = np.zeros((self.size, 0), dtype=np.float32)
        self.landmarks = self.presence([texts[i] for i in marks])[0].T.copy()
        k_mm = self.kernel([texts[i] for i in marks])[0]
        values, vectors = np.linalg.eigh(k_mm.astype(np.float64))
        good = values > 1e-6 * values.max()
        root = vectors[:, good] / np.sqrt(values[good])
        k_nm = np.concatenate([self.kernel(texts[a : a + BLOCK_TEXTS])[0] for a in range(0, len(texts), BLOCK_TEXTS)]).astype(np.float64)
        phi = k_nm @ root
        y = (np.array(labels)[:, None] == np.array(self.languages)[None, :]).astype(np.float64)
        w = np.linalg.solve(phi.T @ phi + ridge * len(texts) / phi.shape[1] * np.eye(phi.shape[1]), phi.T @ y)
        self.coefficients = (root @ w).astype(np.float32)
        self.landmarks = self.landmarks.astype(np.float32)

    def presence(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts x landmark grams, rows of unit length; and which texts have letters."""
        sym, owner, has = symbols(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), self.symbol)
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        for code, who in grams(sym, owner, self.width):
            number = self.number[code]
            hit = number >= 0
            out[who[hit], number[hit]] = 1
        out /= np.sqrt(np.maximum(out.sum(1, keepdims=True), 1))
        return out, has

    def kernel(self, texts: list[str] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        x, has = self.presence(texts)
        return x @ self.landmarks, has

    def responses(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        k, has = self.kernel(texts)
        return k @ self.coefficients, has


def sample(docs: DataFrame, train: Column, max_train: int, max_chars: int) -> list[tuple[str, str]]:
    """At most ``max_train`` (text, lang) pairs, shared evenly by the languages and alternating between them."""
    labelled = docs.filter(train & F.col("lang").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)).between(1, max_chars))).select("doc_id", "text", "lang")
    counts = stage(labelled.groupBy("lang").agg(F.count("*").alias("_n")))
    n = counts.count()
    if not n:
        return []
    # a language's rows below a hash limit that leaves about twice the rows wanted, so that no task ranks a whole language
    each = max(1, max_train // n)
    hashed = labelled.withColumn("_h", F.xxhash64("doc_id", "text", F.lit(11))).join(small(counts), "lang")
    few = hashed.filter(F.pmod("_h", F.lit(1 << 20)) * F.col("_n") < F.lit((1 << 20) * (2 * each + 50)))
    # repeated rows count once, so the same rows are drawn in every run
    order = Window.partitionBy("lang").orderBy("_h")
    drawn = few.dropDuplicates(["lang", "_h"]).withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= each)
    rows = drawn.orderBy("_r", "_h", "lang").limit(max_train).select("_r", "_h", "text", "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["_r"], r["_h"], r["lang"], r["text"]))]


def identify(
    docs: DataFrame, train: Column, max_train: int = MAX_TRAIN, max_landmarks: int = MAX_LANDMARKS, max_chars: int = MAX_CHARS, ridge: float = RIDGE,
    pred: str = "lang_pred", score: str = "score",
) -> DataFrame:
    """The rows of docs (doc_id, text, lang, ...) with columns ``pred`` and ``score`` (in place of any of these names);
    ``train`` marks the rows to learn from."""
    pairs = sample(docs, train, max_train, max_chars)
    model = Model([p[0] for p in pairs], [p[1] for p in pairs], max_landmarks, ridge, ALPHABET) if pairs else None
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(pred, score)
    names = [*docs.columns, pred, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        m = sent.value
        for big in slices(batches, "text", BLOCK_BYTES):
            for a in range(0, big.num_rows, BLOCK_TEXTS):
                batch = big.slice(a, BLOCK_TEXTS)
                n = batch.num_rows
                if m is None:
                    pred, top = np.full(n, UNDETERMINED, dtype=object), np.zeros(n)
                else:
                    y, has = m.responses(batch.column("text"))
                    best = y.argmax(1)
                    pred = np.where(has, np.array(m.languages, dtype=object)[best], UNDETERMINED)
                    top = np.where(has, np.clip(y[np.arange(n), best].astype(np.float64), 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(top)], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, `{pred}` string, `{score}` double")
