"""Vector bin packing of tokenised documents into training sequences.

Every sequence has three limits at once: tokens, segments (pieces) and loss-bearing tokens. Documents are cut at whole
sequences; what remains goes to open bins by the dot-product heuristic: of the pieces that fit, the one whose demand
vector has the largest dot product with the bin's free capacity. When none fits, the best one is cut to fill the bin.
A bin that can't be filled (segment or loss limit, end of the block) is cut back to a power of two, which needs no
padding; what is cut off opens the next bin.

Each scan partition packs its own documents in blocks of bounded size, so there is no shuffle and a lost task is simply
run again. sequence_id is the partition's number times 2**32 plus a count.

Edge cases: a null or empty text still has its end id; rows with equal doc_id are packed apart, each with its own
pieces; a text longer than a block is a block of its own; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm._text import CACHES, slices, trim, words

MAX_TOKENS, MAX_SEGMENTS, END_ID = 2048, 256, 1
TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are tokenised and packed together, and pieces that compete for a bin.
BLOCK_BYTES, POOL = 3 << 20, 1024
#: Words whose ids a worker remembers.
REMEMBER = 250_000
#: A word that ends in a Latin letter or digit and a run of ASCII punctuation.
CORE_AND_TAIL = r"^(?P<core>[^'<]*[0-9A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{17F}])(?P<tail>[.,!#$%&*?;:\"|)]+)$"

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces (doc, start, length); ``loss_from`` is the first loss-bearing position of each document."""

    def __init__(self, lengths: np.ndarray, loss_from: np.ndarray | None, limits: tuple[int, int, int]):
        self.lengths, self.loss_from = lengths, np.zeros_like(lengths) if loss_from is None else loss_from
        self.limits = limits
        self.out: list[tuple[int, int, int, int, int]] = []  # doc, start, length, sequence, offset
        self.n = 0

    def loss(self, doc: int, start: int, length: int) -> int:
        return max(0, start + length - max(start, int(self.loss_from[doc])))

    def close(self, pieces: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Write a sequence; what exceeds the largest power of two comes back as pieces."""
        total = sum(p[2] for p in pieces)
        if total == 0:
            return pieces
        room = total if total == self.limits[0] else 1 << (total.bit_length() - 1)
        at, back = 0, []
        for doc, start, length in pieces:
            n = min(length, room - at)
            if n:
                self.out.append((doc, start, n, self.n, at))
                at += n
            if n < length:
                back.append((doc, start + n, length - n))
        self.n += 1
        return back

    def run(self) -> None:
        most, segments, most_loss = self.limits
        rest: list[tuple[int, int, int]] = []
        for doc, length in enumerate(self.lengths.tolist()):
            start, step = 0, min(most, most_loss)
            while most == step and length - start >= most:
                self.out.append((doc, start, most, self.n, 0))
                self.n += 1
                start += most
            if start < length:
                rest.append((doc, start, length - start))
        rest.sort(key=lambda p: -p[2])
        pools = max(1, -(-len(rest) // POOL))
        carry: list[tuple[int, int, int]] = []
        for k in range(pools):
            carry = self.fill(rest[k::pools] + carry, last=k == pools - 1)

    def fill(self, pool: list[tuple[int, int, int]], last: bool) -> list[tuple[int, int, int]]:
        """Pack a pool; returns the pieces of the last open bin unless ``last``."""
        most, segments, most_loss = self.limits
        scale = np.array([1 / most, 1 / segments, 1 / most_loss])
        pieces = np.array(pool, dtype=np.int64).reshape(-1, 3)
        loss = np.array([self.loss(*p) for p in pool], dtype=np.int64)
        live = np.ones(len(pool), dtype=bool)
        left = len(pool)
        bin_: list[tuple[int, int, int]] = []
        free = np.array([most, segments, most_loss], dtype=np.int64)

        def put(p: tuple[int, int, int]) -> None:
            bin_.append(p)
            free[:] -= (p[2], 1, self.loss(*p))

        while left:
            demand = np.stack([pieces[:, 2], np.ones(len(pieces), dtype=np.int64), loss], axis=1)
            while left:
                if free[0] and free[1]:
                    value = (demand * scale) @ (free * scale)
                    fits = live & (demand <= free).all(axis=1)
                    if fits.any():
                        i = int(np.argmax(np.where(fits, value, -1.0)))
                        live[i] = False
                        left -= 1
                        put(tuple(pieces[i].tolist()))
                        continue
                    i = int(np.argmax(np.where(live, value, -1.0)))
                    doc, start, length = pieces[i].tolist()
                    n = min(length, int(free[0]))
                    if self.loss(doc, start, n) > free[2]:
                        n = max(0, int(self.loss_from[doc]) - start) + int(free[2])
                    if n > 0:
                        put((doc, start, n))
                        pieces[i] = (doc, start + n, length - n)
                        loss[i] = self.loss(doc, start + n, length - n)
                        demand[i] = (length - n, 1, loss[i])
                back = self.close(bin_)
                bin_ = []
                free[:] = (most, segments, most_loss)
                for p in back:
                    put(p)
            live = np.zeros(0, dtype=bool)
        if not last:
            return bin_
        while bin_:
            bin_ = self.close(bin_)
        return []


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[at : at + n], one after the other; and where each run ends."""
    stop = np.cumsum(n)
    total = int(stop[-1]) if len(stop) else 0
    kind = np.int32 if max(total, len(flat)) < 2**31 else np.int64
    where = np.repeat((at - (stop - n)).astype(kind), n)
    where += np.arange(total, dtype=kind)
    return flat[where], stop


class Ids:
    """Ids of words by a tokenizer that splits at white space; a bounded number of words is remembered."""

    def __init__(self, path: str):
        # a task has one core; threads of the library would only add memory
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.of = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.flat, self.stop = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def __call__(self, vocabulary: list[str], remember: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word begin in ``flat``, and how many they are."""
        new = [w for w in vocabulary if w not in self.number]
        if self.number and len(self.number) + len(new) > remember:
            self.forget()
            new = vocabulary
        flats, stops = [self.flat], [self.stop]
        for a in range(0, len(new), 2000):
            part = new[a : a + 2000]
            ids = [e.ids for e in self.of.encode_batch_fast(part, add_special_tokens=False)]
            n = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            flats.append(np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(n.sum())))
            stops.append(stops[-1][-1] + np.cumsum(n))
            self.number.update(zip(part, range(len(self.number), len(self.number) + len(part)), strict=True))
        self.flat, self.stop = np.concatenate(flats), np.concatenate(stops)
        at = np.fromiter(map(self.number.__getitem__, vocabulary), dtype=np.int64, count=len(vocabulary))
        return self.stop[at], self.stop[at + 1] - self.stop[at]


_ids: dict[str, Ids] = {}
CACHES.append(_ids)


def token_ids(texts: pa.Array, path: str, remember: int = REMEMBER) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, each text's ids followed by END_ID; and the number of ids of each text.

    The tokenizer lowers case, replaces white space by single spaces and drops it between words, so texts are cut at
    ASCII white space and each distinct word is encoded once. A word's trailing run of ASCII punctuation after a Latin
    letter or digit (which no normal form turns into anything else) is a token run of its own and is encoded apart,
    which makes words repeat more often. Words that hold a control string or an apostrophe are encoded as they are.
    """
    if path not in _ids:
        _ids[path] = Ids(path)
    encode = _ids[path]
    vocabulary, index, counts = words(texts, lower=False)
    parts = pc.extract_regex(vocabulary, CORE_AND_TAIL)
    core = pc.coalesce(pc.struct_field(parts, "core"), vocabulary)
    tail = pc.coalesce(pc.struct_field(parts, "tail"), pa.scalar(""))
    core = pc.if_else(pc.match_substring(core, "<|"), core, pc.ascii_lower(core))
    both = pa.concat_arrays([core.cast(pa.string()), tail.cast(pa.string())]).dictionary_encode()
    at, n = encode(both.dictionary.to_pylist(), remember)
    code = both.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.ravel()
    flat, stop = gather(encode.flat, at[code], n[code])
    stop = stop[1::2]
    at, n = np.concatenate(([0], stop[:-1])) if len(stop) else stop, np.diff(stop, prepend=0)
    # a run for each token, and one for the end id of each text
    slot = np.arange(len(index)) + np.repeat(np.arange(len(counts)), counts)
    runs, length = np.full(len(index) + len(counts), len(flat), dtype=np.int64), np.ones(len(index) + len(counts), dtype=np.int64)
    runs[slot], length[slot] = at[index], n[index]
    out, stop = gather(np.append(flat, np.uint32(END_ID)), runs, length)
    return out, np.diff(stop[np.cumsum(counts) + np.arange(len(counts))], prepend=0)


def pack(
    docs: DataFrame,
    tokenizer: str | None = None,
    max_tokens: int = MAX_TOKENS,
    max_segments: int = MAX_SEGMENTS,
    max_loss: int | None = None,
    block_bytes: int = BLOCK_BYTES,
    remember: int = REMEMBER,
    loss_from: str | None = None,
) -> DataFrame:
    """The pieces of ``docs`` (doc_id, text): every id lies in exactly one piece of one sequence.

    ``tokenizer`` is a path, or by default the name of a public tokenizer that each executor looks up for itself.
    ``loss_from`` names a column with the number of leading ids of each document that bear no loss (a masked prompt; null:
    none, more than there are: all), and a sequence has at most ``max_loss`` of the others; without it all ids bear loss.
    With it, the pieces have a further column loss_tokens. ``block_bytes`` and ``remember`` trade memory for time.
    """
    limits = (max_tokens, max_segments, max_loss or max_tokens)

    schema = SCHEMA if loss_from is None else f"{SCHEMA}, loss_tokens long"
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        trim()
        path = tokenizer or public_tokenizers.path(TOKENIZER)
        first = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", block_bytes):
            ids, lengths = token_ids(batch.column("text"), path, remember)
            masked = None
            if loss_from is not None:
                masked = np.clip(pc.fill_null(batch.column("loss_from"), 0).to_numpy(zero_copy_only=False).astype(np.int64), 0, lengths)
            packer = Packer(lengths, masked, limits)
            packer.run()
            got = np.array(packer.out, dtype=np.int64).reshape(-1, 5)
            doc, start, n, sequence, offset = got.T
            at = np.concatenate(([0], np.cumsum(lengths)))[doc] + start
            view = memoryview(np.ascontiguousarray(ids.astype("<u4"))).cast("B")
            crc = [zlib.crc32(view[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            columns = [start, n, np.array(crc, dtype=np.int64), lengths[doc], sequence + first, offset]
            if masked is not None:
                columns.append(np.maximum(0, start + n - np.maximum(start, masked[doc])))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc)), *map(pa.array, columns)], names=names)
            first += packer.n
        trim()

    if loss_from is None:
        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
    return docs.select("doc_id", "text", F.col(loss_from).cast("long").alias("loss_from")).mapInArrow(run, schema)
