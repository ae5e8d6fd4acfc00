"""Arrow and numpy helpers that several operators share: whole batches of texts, no per-row Python."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Words in Java and DuckDB regular expressions.
WORD = r"[^\x20\x09-\x0D]+"


#: What operators remember between the tasks of a Python worker.
CACHES: list[dict] = []


def trim() -> None:
    """Give free memory back: Spark reuses Python workers, and what they keep counts against the executor's memory."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def fresh() -> None:
    """Drop what other operators remember, and give the memory back."""
    for cache in CACHES:
        cache.clear()
    trim()


def free(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name in docs.columns:
        name += "_"
    return name


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the word number of each token, and the tokens of each text (null: none).

    Words are the maximal runs of anything but space and U+0009 to U+000D; ``lower`` maps A-Z only.
    """
    t = pc.fill_null(texts, "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(t) if lower else t)
    if isinstance(split, pa.ChunkedArray):
        split = split.combine_chunks()
    offsets, flat = split.offsets.to_numpy(), split.values
    full = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    before = np.concatenate(([0], np.cumsum(full)))
    counts = (before[offsets[1:]] - before[offsets[:-1]]).astype(np.int64)
    coded = flat.filter(pa.array(full)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), counts


def word_codes(vocabulary: pa.Array, edge: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, each between two ``edge`` marks; the word of each code; the codes of each word."""
    n = len(vocabulary)
    text = chr(edge) + (chr(edge) * 2).join(vocabulary.to_pylist()) + chr(edge) if n else ""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = pc.utf8_length(vocabulary).to_numpy(zero_copy_only=False).astype(np.int64) + 2
    return codes, np.repeat(np.arange(n), lengths), lengths


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Cut batches into slices of about ``most`` bytes of ``column``; a longer text makes a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes.astype(np.int64)) // most
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [batch.num_rows]))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(a, b - a)
