"""The corpus operators on small tables: brute-force versions, exact round trips, held-out accuracy, and edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.llm import chat, hmm, langid, minhash, mixing, neighbours, packing, pii, spotsigs, toxicity
from quern.llm.queries import ORACLE, QUERIES, pii_key, remainder
from tests.compare import check, duck

SF = "/root/testdata/sf0.001"
KEY = b"quern test key"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, rank int"
#: Nulls in every column, empty and blank texts, one word, control strings, ties, repeated rows, a long text; clashing columns.
ODD = [
    (1, None, None, None, None, None, None, None),
    (2, "", "en", "a", 0, 1.0, "x", 1),
    (3, " \t\n\x0b\x0c\r ", "en", "a", 6, None, None, 2),
    (4, "word", "en", None, 4, 0.5, "y", 3),
    (5, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 70, 0.0, "z", 4),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 70, 0.0, "z", 4),
    (6, "The quick brown fox jumps over the lazy dog near the old river bank today", "en", "b", 70, 0.0, "z", 4),
    (7, "<|endoftext|> </s>[INST] ~0 <turn> it's 'S é ﬁ İ. 5.5 \U0001f600", "fr", "c", 10, None, None, None),
    (8, " ".join(f"mot{i % 97}x{i % 89}" for i in range(30000)), "fr", "c", 1, None, None, None),
    (None, "der Hund und die Katze", "de", "d", 22, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    check(QUERIES[name](spark, SF), duck(SF), ORACLE[name])


# 1


def test_language_held_out(spark):
    found = QUERIES["op1_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_kernel_is_presence_cosine():
    texts, labels = ["the cat sat", "le chat est la", "the dog sat on the mat", "la vie est belle"], ["en", "fr", "en", "fr"]
    m = langid.Model(texts, labels, 4, 0.01, 100)

    def grams(t):
        t = re.sub("[^a-z]+", " ", t)
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    every = set().union(*map(grams, texts))
    x = "the chat is 3 mat!"
    k = m.kernel([x])[0][0]
    for value, t in zip(k, texts, strict=True):
        a, b = grams(x) & every, grams(t)
        assert value == pytest.approx(len(a & b) / math.sqrt(len(a) * len(b)), abs=1e-5)


def test_language_edges(odd, empty):
    rows = langid.identify(odd, F.lit(True)).collect()
    assert len(rows) == len(ODD)
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert langid.identify(empty, F.lit(True)).count() == 0


# 2


def brute_counts(rows):
    c = Counter(w for d, t in rows if zlib.crc32(str(d).encode()) % 10 for w in [*words(lower(t)), None])
    return c, sum(c.values()), len(c)


def test_hmm_base_and_gain(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    c, n, v = brute_counts(rows)
    found = {r["doc_id"]: r for r in QUERIES["op2_hmm"](spark, SF).collect()}
    for d, t in rows:
        w = [*words(lower(t)), None]
        r = found[d]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_hmm_forward_and_counts_are_exact():
    rng = np.random.default_rng(0)
    m = hmm.Model(np.array([0.6, 0.4]), np.array([[0.7, 0.3], [0.2, 0.8]]), rng.dirichlet(np.ones(5), 2))
    texts = [np.array([1, 2, 3]), np.array([], dtype=int), np.array([4]), np.array([2, 2])]
    order, flat, live = hmm.lattice(texts)
    logs = np.zeros(4)
    logs[order] = hmm.forward(m, flat, live, False)[0]
    start, move, emit, total = hmm.expected(m, flat, live)
    import itertools

    s0, a0, e0 = np.zeros(2), np.zeros((2, 2)), np.zeros((2, 5))
    for i, t in enumerate(texts):
        obs = [*t.tolist(), 0]
        paths = {p: m.start[p[0]] * m.emit[p[0], obs[0]] * math.prod(m.move[a, b] * m.emit[b, o] for a, b, o in zip(p, p[1:], obs[1:], strict=False)) for p in itertools.product(range(2), repeat=len(obs))}
        z = sum(paths.values())
        assert logs[i] == pytest.approx(math.log(z))
        for p, w in paths.items():
            s0[p[0]] += w / z
            for a, b in zip(p, p[1:], strict=False):
                a0[a, b] += w / z
            for s, o in zip(p, obs, strict=True):
                e0[s, o] += w / z
    assert np.allclose(start, s0, atol=1e-5) and np.allclose(move, a0, atol=1e-5) and np.allclose(emit, e0, atol=1e-5) and total == pytest.approx(logs.sum(), rel=1e-5)


def test_hmm_blocks_are_built_in_pieces(monkeypatch):
    """A block spans batches and is tokenised a piece at a time; its documents are written some at a time."""
    sizes, plain = [], hmm.words
    monkeypatch.setattr(hmm, "words", lambda t: sizes.append(sum(len(x or "") for x in t.to_pylist())) or plain(t))
    for name, value in (("BLOCK_BYTES", 4000), ("PIECE_BYTES", 400), ("ROWS", 7)):
        monkeypatch.setattr(hmm, name, value)
    texts = [None if i % 11 == 0 else "" if i % 13 == 0 else f"w{i % 5} w{i % 7}  x{i}" * (1 + i % 3) for i in range(500)]
    batches = [pa.record_batch([pa.array(range(a, a + 50), pa.int64()), pa.array(texts[a : a + 50]), pa.array([i % 10 for i in range(a, a + 50)], pa.int32())], names=["doc_id", "text", "part"]) for a in range(0, 500, 50)]
    blocks = list(hmm.gathered(iter(batches)))
    assert max(sizes) <= 450 and 1 < len(blocks) < 5
    found = {}
    for docs, vocabulary, index, counts in blocks:
        rows = list(hmm.written(1, docs, vocabulary, index, counts, 64))
        words = {n: (w, k) for b in rows for w, n, k in zip(*(b.column(c).to_pylist() for c in ("word", "number", "n")), strict=True) if w is not None}
        assert all(b.num_rows <= 7 for b in rows if b.column("tokens").null_count == 0)
        seen = Counter()
        for b in rows:
            for d, t, c in zip(*(b.column(c).to_pylist() for c in ("doc_id", "tokens", "classes")), strict=True):
                if d is not None:
                    numbers = np.frombuffer(t, "<i4").tolist()
                    assert len(c) * 2 == len(t)
                    found[d] = [words[n][0] for n in numbers]
                    seen.update(numbers if d % 10 else [])
        assert {n: k for n, (_, k) in words.items() if k} == dict(seen)
    assert found == {i: (t or "").split() for i, t in enumerate(texts)}


def test_hmm_edges(odd, empty):
    rows = {r["doc_id"]: r for r in hmm.score(odd, F.lit(1)).collect()}
    assert rows[1]["n_tokens"] == rows[2]["n_tokens"] == rows[3]["n_tokens"] == 1 and rows[8]["n_tokens"] == 30001
    assert all(math.isfinite(r["score"]) for r in rows.values())
    assert hmm.score(empty, F.lit(1)).count() == 0
    assert all(r["n_known"] == 0 and math.isfinite(r["score"]) for r in hmm.score(odd, F.lit(0)).collect())


# 3


def check_pieces(rows, pieces, most=2048, segments=256):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for d, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want[d, tuple(ids)] += 1
    by = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
    for (d, ids), times in want.items():
        mine = [p for p in by[d] if p["doc_tokens"] == len(ids)]
        cover = Counter()
        for p in mine:
            part = np.array(ids[p["start"] : p["start"] + p["length"]], dtype="<u4")
            assert len(part) == p["length"] > 0 and zlib.crc32(part.tobytes()) == p["ids_crc32"]
            cover.update(range(p["start"], p["start"] + p["length"]))
        assert cover == Counter({i: times for i in range(len(ids))})
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p["sequence_id"]].append((p["offset"], p["length"]))
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= most and len(s) <= segments
        padding += 0 if at & (at - 1) == 0 else most - at
    return padding


def test_packing(spark, docs, odd, empty):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert check_pieces(rows, packing.pack(docs).collect()) == 0
    assert check_pieces([(r[0], r[1]) for r in ODD], packing.pack(odd).collect()) == 0
    assert packing.pack(empty).count() == 0


def test_packing_keeps_all_limits():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 3000, 400)
    first = (lengths * rng.random(400)).astype(int)
    p = packing.Packer(lengths, first, (2048, 5, 700))
    p.run()
    sequences, cover = defaultdict(list), Counter()
    for doc, start, n, sequence, offset in p.out:
        sequences[sequence].append((doc, start, n))
        cover[doc] += n
    assert all(cover[i] == n for i, n in enumerate(lengths))
    for s in sequences.values():
        assert sum(x[2] for x in s) <= 2048 and len(s) <= 5 and sum(p.loss(*x) for x in s) <= 700


def test_packing_of_masked_prompts(spark, docs, odd):
    """A limit on loss-bearing ids that binds: prompts of known length, every id once, all three limits kept."""
    sizes = {(r["doc_id"], r["doc_tokens"]) for r in packing.pack(docs).collect()}
    masked = docs.withColumn("prompt", F.when(F.col("doc_id") % 7 == 0, None).otherwise(F.col("doc_id") * 13 % 90))
    first = {r["doc_id"]: r["prompt"] or 0 for r in masked.collect()}
    free = Counter()
    for r in packing.pack(masked, max_segments=6, loss_from="prompt").collect():
        free[r["sequence_id"]] += r["loss_tokens"]
    assert max(free.values()) > 900
    pieces = packing.pack(masked, max_segments=6, max_loss=900, loss_from="prompt").collect()
    assert {(r["doc_id"], r["doc_tokens"]) for r in pieces} == sizes
    cover, loss, count, tokens = Counter(), Counter(), Counter(), Counter()
    for r in pieces:
        assert r["loss_tokens"] == sum(p >= first[r["doc_id"]] for p in range(r["start"], r["start"] + r["length"]))
        cover[r["doc_id"]] += r["length"]
        loss[r["sequence_id"]] += r["loss_tokens"]
        count[r["sequence_id"]] += 1
        tokens[r["sequence_id"]] += r["length"]
    assert cover == dict(sizes) and 700 < max(loss.values()) <= 900 and max(count.values()) <= 6 and max(tokens.values()) <= 2048
    assert sum(r["length"] for r in packing.pack(odd.withColumn("p", F.lit(10**6)), max_loss=5, loss_from="p").collect()) == sum(r["length"] for r in packing.pack(odd).collect())


# 4


def brute_chat(rows):
    out = {}
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_reads_back(spark):
    rows = [
        (1, 0, "system", "be ~1 brief <end>"), (1, 1, "user", "a " * 300), (1, 2, "assistant", "b [" * 200), (1, 3, "user", ""), (1, 4, "assistant", None), (1, 5, "user", "c " * 700), (1, 6, "assistant", "~0~2<turn>"),
        (2, 0, "user", "x"), (2, 0, "user", "x"), (3, None, None, None), (None, 1, "assistant", "y"), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    windows = chat.format_windows(table.withColumn("pos", F.lit(1)).withColumn("size", F.lit("x")), 256, 64)
    found = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_back(windows).collect()}
    assert found == brute_chat(rows)
    one = [r for r in windows.collect() if r["conv_id"] == 1]
    assert len(one) > 2 and all("be ~01 brief ~1end>" in r["formatted"] for r in one)
    assert sum(r["formatted"].count("<past>system") for r in one) == len(one) - 1
    assert chat.read_back(chat.format_windows(table.limit(0))).count() == 0


# 5


def brute_targets(sizes, cap=3):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, open_, target = sum(sizes.values()), set(names), {}
    while open_:
        left, w = total - sum(target.values()), sum(weight[n] for n in open_)
        over = [n for n in open_ if left * weight[n] / w > cap * sizes[n]]
        if not over:
            target |= {n: left * weight[n] / w for n in open_}
            break
        target |= {n: cap * sizes[n] for n in over}
        open_ -= set(over)
    return target


def test_mixing(spark, docs, odd, empty):
    for table in (docs, odd.filter("doc_id is not null").dropDuplicates(["doc_id"])):
        rows = {r["doc_id"]: r for r in table.collect()}
        plan = mixing.mix(table)
        found = plan.collect()
        sizes, taken = Counter(), Counter()
        for d, r in rows.items():
            sizes[r["source"]] += len(words(r["text"]))
        target = brute_targets(sizes)
        for r in found:
            n = len(words(rows[r["doc_id"]]["text"]))
            source = rows[r["doc_id"]]["source"]
            assert r["size"] == n and 0 <= r["taken"] <= 3 * n and r["source_size"] == sizes[source]
            assert r["target"] == pytest.approx(target[source])
            taken[source] += r["taken"]
        assert len(found) == len(rows) and all(abs(taken[s] - t) <= mixing.BLOCK_WORDS for s, t in target.items())
        assert sorted(map(tuple, mixing.mix(table).collect())) == sorted(map(tuple, found))
        real = Counter()
        for r in mixing.realize(table, plan).collect():
            real[r["doc_id"]] += len(words(r["text"]))
        assert real == Counter({r["doc_id"]: r["taken"] for r in found if r["taken"]})
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(odd).count() == len(ODD)


def test_apportionment_is_sainte_lague(spark):
    rng = random.Random(3)
    votes = [("g", i, rng.randint(0, 10 ** rng.randint(1, 5)), 1000) for i in range(60)] + [("h", i, 10, 7) for i in range(5)]
    rows = spark.createDataFrame(votes, "g string, i int, v long, s long")
    found = {(r["g"], r["i"]): r["out"] for r in mixing.apportion(rows, ["g"], "v", "s", ["i"], "out").collect()}
    for g, seats in (("g", 1000), ("h", 7)):
        won = Counter()
        mine = [(v, i) for x, i, v, _ in votes if x == g]
        for _ in range(seats):
            v, i = max(mine, key=lambda p: (p[0] / (2 * won[p[1]] + 1), -p[1]))
            won[i] += 1
        assert {i: found[g, i] for _, i in mine} == {i: won[i] for _, i in mine}


# 6


def test_pii_round_trip_and_links():
    text = "Call +1 (555) 010-9999, card 4111 1111 1111 1111 or 4111-1111-1111-1111, 10.0.0.255, 2020-02-29, 31.12.1999, 078-05-1120, a.b9@mail.example.org, GB82 WEST 1234 5698 7654 32."
    out, found = pii.pseudonymise(text, KEY)
    assert found == {"phone": 1, "card": 2, "ip": 1, "date": 2, "ssn": 1, "email": 1, "iban": 1}
    assert len(out.split()) == len(text.split()) and pii.pseudonymise(out, KEY, back=True)[0] == text
    cards = [re.sub(r"\D", "", m[0]) for m in re.finditer(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", out)]
    assert cards[0] == cards[1] != "4111111111111111" and pii.luhn(cards[0])
    assert pii.pseudonymise(text, b"other")[0] != out
    for clean in ("4111 1111 1111 1112", "999.1.1.1", "2021-02-29", "no digits", "1234567890123456", "v1.2.3.4.5", "000-12-3456", "token = \"98a1\""):
        assert pii.pseudonymise(clean, KEY) == (clean, {})


def test_pii_next_to_other_groups():
    """A value beside short digit groups or upper-case words is found, though the longest run fails validation."""
    card, iban = "4111 1111 1111 1111", "BE68 5390 0754 7034"
    for a, value, b in (
        ("", card, " 12/25"), ("", "4111111111111111", " 123"), ("no 12 ", card, ""), ("no 12 ", card, " 34"), ("AB12 ", card, ""), ("2021-02-30 ", card, " 1"),
        ("9 ", "3782-822463-10005", " 77"), ("", "4222222222222", " 5"), ("", iban, " CALL NOW"), ("", "BE68539007547034", " EUR"), ("", iban, " 1234 12"), ("XK00 0000 ", iban, ""),
        ("12 34 ", "078-05-1120", " 99 11"), ("", "555-010-9999", " 123"),
    ):
        out, found = pii.pseudonymise(a + value + b, KEY)
        new = out[len(a) : len(a) + len(value)]
        assert sum(found.values()) == 1 and out == a + new + b and new != value, (a, value, b, out)
        assert new == pii.pseudonymise(value, KEY)[0] and pii.pseudonymise(out, KEY, back=True)[0] == a + value + b
    both = f"{card} 5500 0000 0000 0004 {iban} {iban} 12"
    assert pii.pseudonymise(both, KEY)[1] == {"card": 2, "iban": 2}
    assert pii.pseudonymise("+1 (826) 555-4081 190.137.223.204", KEY)[1] == {"phone": 1, "ip": 1}
    for clean in ("4111 1111 1111 1112 12", "BE68 5390 0754 7035 CALL NOW"):
        assert pii.pseudonymise(clean, KEY)[1] == {}, clean


def test_pii_links_across_spellings_and_scripts():
    """Every value changes, and one value has one pseudonym in each of the spellings that the docstring names."""
    new = {x: pii.pseudonymise(x, KEY)[0] for x in (
        "2024-03-09", "2024/03/09", "09.03.2024", "09-03-2024", "03/09/2024", "+1 826 555 4081", "826-555-4081", "(826) 555-4081",
        "иван.петров@example.com", "łukasz@example.com", "李小龙@example.com", "μαρία9@example.com", "a@b.com",
    )}
    day = lambda s, order: dict(zip(order, re.findall(r"\d+", s), strict=True))
    assert day(new["2024-03-09"], "ymd") == day(new["2024/03/09"], "ymd") == day(new["09.03.2024"], "dmy") == day(new["09-03-2024"], "dmy") == day(new["03/09/2024"], "mdy")
    assert len({re.sub(r"\D", "", new[x])[-10:] for x in ("+1 826 555 4081", "826-555-4081", "(826) 555-4081")}) == 1
    for old, x in new.items():
        assert x != old and pii.pseudonymise(old, KEY)[1] and pii.pseudonymise(x, KEY, back=True)[0] == old, old
        if "@" in old:
            local, was = x.split("@")[0], old.split("@")[0]
            assert all(a != b or not b.isalnum() for a, b in [(local, was)]) and [unicodedata.category(c) for c in local] == [unicodedata.category(c) for c in was]
    letters = {c: pii.pseudonymise(f"{c}@b.com", KEY)[0] for c in "abcdefghijklmnopqrstuvwxyz"}
    assert len(set(letters.values())) == 26 and all(x[0] != c for c, x in letters.items())


def brute_card(text, key):
    """Cards alone, found by trying every run of 13 to 19 digits that stands apart."""
    return re.sub(r"(?<![\w.])\d{13,19}(?![\w.])", lambda m: pii.card(m[0], key) or m[0], text)


def test_pii_of_a_planted_table(spark):
    """Replaced values against brute force, equal values linked across rows, all other text untouched."""
    rng = random.Random(4)

    def number():
        body = "".join(rng.choices("0123456789", k=15))
        return next(body + d for d in "0123456789" if pii.luhn(body + d))

    cards = [number() for _ in range(20)]
    rows = [(i, f"order {i % 7} by {cards[i % 20]} of {'x' * (i % 5)} value {i}. No {number()[:-1]}x") for i in range(200)]
    found = pii.replace_pii(spark.createDataFrame(rows, "doc_id long, text string"), KEY).collect()
    assert {r["doc_id"]: (r["text"], r["n_card"]) for r in found} == {i: (brute_card(t, KEY), 1) for i, t in rows}
    used = defaultdict(set)
    for r in found:
        used[cards[r["doc_id"] % 20]].add(r["text"].split(" by ")[1].split()[0])
    assert all(len(x) == 1 for x in used.values()) and len(set.union(*used.values())) == len(set(cards))


def test_feistel_is_a_permutation():
    for size in (1, 2, 7, 10, 100, 1000):
        image = [pii.feistel(i, size, b"k", b"t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [pii.feistel(x, size, b"k", b"t", True) for x in image] == list(range(size))
        image = [pii.moved(i, size, b"k", b"t") for i in range(size)]
        assert sorted(image) == list(range(size)) and [pii.moved(x, size, b"k", b"t", True) for x in image] == list(range(size))
        assert size == 1 or all(i != x for i, x in enumerate(image))


def test_pii_edges(odd, empty):
    rows = pii.replace_pii(odd, KEY).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r[0], r[1]) for r in ODD)
    assert pii.replace_pii(empty, KEY).count() == 0


# 7


def test_neighbours_brute_force(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(120, 6)).round(1)
    rows = [(i, x.tolist()) for i, x in enumerate(base)] + [(200 + i, base[0].tolist()) for i in range(30)]
    rows += [(300, None), (301, [0.0] * 6), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (303, [float("nan")] * 6), (304, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0]), (400, [1.0, 2.0]), (401, [2.0, 4.0]), (None, [1.0] * 6), (450, [])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    found = defaultdict(list)
    for r in neighbours.nearest(table, F.col("vec_id") % 10 == 0, 5, 8 * 48, 16 * 48).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(x) for i, x in rows if i is not None and x and None not in x and np.isfinite(x).all() and any(x)}
    for q, x in good.items():
        if q % 10:
            continue
        near = sorted(((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good.items() if i != q and len(y) == len(x)))[:5]
        assert [(n + 1, i) for n, (_, i) in enumerate(near)] == [(a, b) for a, b, _ in sorted(found.pop(q))]
    assert not found
    assert neighbours.nearest(table.limit(0), F.lit(True)).count() == 0


def test_neighbours_of_long_and_extreme_vectors(spark):
    """2,048 dimensions, where sums of code products pass 2**24, and components at both ends of the double range."""
    rng = np.random.default_rng(6)
    base = np.abs(rng.normal(size=(60, 2048))) + 3
    rows = [(i, x.tolist()) for i, x in enumerate(base)]
    rows += [(100 + i, (rng.normal(size=3) * 10.0 ** (200 if i % 2 else -200)).tolist()) for i in range(30)]
    found = defaultdict(list)
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 == 0, 5).collect():
        found[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    good = {i: np.array(x) / np.abs(x).max() for i, x in rows}
    for q, x in good.items():
        if q % 5 == 0:
            near = sorted(((-float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))), i) for i, y in good.items() if i != q and len(y) == len(x)))[:5]
            got = sorted(found[q])
            assert [i for _, i in near] == [i for _, i, _ in got] and np.allclose([-v for v, _ in near], [v for *_, v in got], rtol=0, atol=1e-12)


# 8


def test_toxicity_generalises_to_misspellings():
    rng = random.Random(0)
    clean = [" ".join(rng.choice(["river", "stone", "green", "walk", "bread", "light"]) + str(rng.randint(0, 9)) for _ in range(60)) for _ in range(150)]
    bad = [f"{t} {rng.choice(['idiotic', 'moronic', 'stupidly'])} {rng.choice(['idiot', 'moron', 'stupid'])}" for t in clean]
    model = toxicity.Model(clean + bad, np.array([0.0] * 150 + [1.0] * 150), 1 << 14, 8, 120, 1.0)
    import pyarrow as pa

    s = model.scores(pa.array([clean[0], f"{clean[0]} idiotik stuppid", "", None]))
    assert s[0] < 0.5 < s[1] and s[2] == s[3] and 0 <= s[2] <= 1


def test_toxicity_query_and_edges(spark, odd, empty):
    found = QUERIES["op8_toxicity"](spark, SF).collect()
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    labels = spark.createDataFrame([(5, 1), (4, 0), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit(odd, labels, F.lit(True))
    assert toxicity.score(odd.select("doc_id", "text"), model).count() == len(ODD)
    assert toxicity.fit(odd, labels.limit(0), F.lit(True)) is None
    assert toxicity.score(empty.select("doc_id", "text"), None).count() == 0


# 9


def brute_near(rows, percent=80):
    sets = {}
    for d, t in rows:
        w = words(lower(t))
        sets.setdefault(d, {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and min(len(x), len(y)) * 100 >= percent * max(len(x), len(y)):
                n = len(x & y)
                if 100 * n >= percent * (len(x) + len(y) - n):
                    a1, b1 = top(a), top(b)
                    parent[max(a1, b1)] = min(a1, b1)
    return {d: (len(sets[d]), top(d), top(d) == d) for d in sets}


def found_near(table, **how):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(table, **how).collect()}


def test_near_duplicates_brute_force(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert found_near(docs) == brute_near(rows)
    assert found_near(docs, percent=85) == brute_near(rows, 85)


def test_near_duplicates_of_one_large_group(spark):
    """Variants of one text with one to eight edits: no link may be lost in buckets too large to list their pairs."""
    rng = random.Random(7)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8])):
            w[rng.randrange(len(w))] = f"e{rng.randint(0, 40)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [(5000 + i, " ".join(f"u{i}x{j}" for j in range(50))) for i in range(20)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute_near(rows)
    assert found_near(table, pairs_up_to=4) == want
    assert found_near(table, pairs_up_to=10**6) == want


def test_near_duplicates_edges(spark, odd, empty):
    table = odd.filter("doc_id is not null").withColumn("component_id", F.lit(9)).withColumn("rep", F.lit("x"))
    assert found_near(table) == brute_near([(r[0], r[1]) for r in ODD if r[0] is not None])
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 300).astype(np.uint64)
    b = np.concatenate((a[:240], rng.integers(0, 2**63, 60).astype(np.uint64)))
    few = a[:3]
    h, owner = np.concatenate((a, b, few)), np.repeat([0, 1, 2], [300, 300, 3])
    s = minhash.sketch(h, owner, 4, 512)
    assert (s[:3] != np.uint64(2**64 - 1)).all() and (s[3] == np.uint64(2**64 - 1)).all()
    assert abs((s[0] == s[1]).mean() - 240 / 360) < 0.08


# 10


def brute_spots(text):
    w = [x for x in re.split(r"[^\w]+|_", text.lower()) if x]
    anchors = set(spotsigs.ANCHORS)
    out = set()
    for i, x in enumerate(w):
        if x in anchors:
            rest = [y for y in w[i + 1 :] if y not in anchors][: spotsigs.CHAIN]
            if rest:
                out.add((x, *rest, *[""] * (spotsigs.CHAIN - len(rest))))
    return out or {text}


def test_fingerprints_brute_force(spark, docs, odd):
    for table in (docs, odd.filter("doc_id <> 6"), odd.filter("doc_id = 5")):
        rows = sorted((r["doc_id"], r["text"] or "") for r in table.collect() if r["doc_id"] is not None)
        found = {r["doc_id"]: r for r in spotsigs.fingerprints(table).collect()}
        for i, (d, t) in enumerate(rows):
            following = rows[(i + 1) % len(rows)][1]
            h = len(t) // 2
            edited = t[: len(t) - h] + following[:h]
            r = found[d]
            assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
            a, b, c = brute_spots(t), brute_spots(edited), brute_spots(following)
            assert r["near_edited"] == pytest.approx(len(a & b) / len(a | b)) and r["near_next"] == pytest.approx(len(a & c) / len(a | c))
            assert len(r["fingerprint"].split()) == len(a) and (r["fingerprint"] == r["edited_fingerprint"]) == (a == b)


def test_fingerprint_edges(odd, empty):
    rows = spotsigs.fingerprints(odd).collect()
    assert len(rows) == len(ODD) and len({r["fingerprint"] for r in rows if r["doc_id"] in (5, 6)}) == 1
    assert spotsigs.fingerprints(empty).count() == 0


def test_pruned_jaccard_agrees_above_the_threshold(spark):
    rows = [([1, 2, 3, 4], [1, 2, 3, 4, 5]), ([1], [1, 2, 3, 4, 5, 6]), ([1, 2], [3, 4])]
    df = spark.createDataFrame(rows, "a array<long>, b array<long>")
    got = [tuple(r) for r in df.select(spotsigs.jaccard("a", "b"), spotsigs.jaccard("a", "b", 0.8)).collect()]
    assert got[0][0] == got[0][1] == pytest.approx(0.8) and got[1][1] == 0 and got[2] == (0, 0)


def test_similar_texts_brute_force(spark, docs, odd):
    """Classes and pairs over length partitions against all pairs, with edited copies of many lengths."""
    rng = random.Random(8)
    base = [r["text"] for r in docs.limit(60).collect() if r["text"]]
    rows = [(i, t) for i, t in enumerate(base)] + [(1000 + i, base[i % len(base)]) for i in range(10)]
    for i in range(60):
        w = words(base[i % 20])
        del w[rng.randrange(len(w)) :: max(2, len(w) // (1 + i % 12))]
        rows.append((2000 + i, " ".join(w)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    members, pairs = spotsigs.similar(table, 0.7)
    sets = {r["doc_id"]: frozenset(r["s"]) for r in spotsigs.with_spots(table, "text", "s").collect()}
    heads = {}
    for d in sorted(sets):
        heads.setdefault(sets[d], d)
    assert {r["doc_id"]: r["class_id"] for r in members.collect()} == {d: heads[s] for d, s in sets.items()}
    want = {}
    for s, a in heads.items():
        for t, b in heads.items():
            if a < b and len(s & t) >= 0.7 * len(s | t):
                want[a, b] = len(s & t) / len(s | t)
    got = {(r["class_a"], r["class_b"]): r["near"] for r in pairs.collect()}
    assert got == pytest.approx(want) and len(want) > 20
    members, pairs = spotsigs.similar(odd)
    assert members.count() == len(ODD) and all(r["near"] >= 0.8 for r in pairs.collect())


def test_toxicity_held_out(spark):
    """Rows that the query holds out, in a corpus with enough of both labels."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("toxic is not null").collect()}
    seen = [(labels[r["doc_id"]], r["predicted"]) for r in QUERIES["op8_toxicity"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    toxic, clean = [p for t, p in seen if t == 1], [p for t, p in seen if t == 0]
    assert len(toxic) >= 3 and sum(toxic) >= 0.8 * len(toxic) and sum(clean) <= 0.05 * len(clean)


def test_pipeline_stages_of_an_empty_table_and_clashing_columns(spark, empty, docs):
    """An empty table stays empty with its columns; columns named like those the stages add pass unchanged."""
    import corpus_pipeline

    steps = corpus_pipeline.STAGES
    for _, step in steps[1:-1]:
        out = step(spark, empty, SF)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.sequences(spark, empty, SF).count() == 0
    names = ["_lang", "_score", "_row", "lang_pred", "size", "taken", "component_id", "kept", "n_email", "_mix", "_split", "_out"]
    table = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names])
    for _, step in steps[:-1]:
        out = step(spark, table, SF)
        assert out.columns == table.columns
        assert out.filter(" or ".join(f"`{n}` <> concat('{n}', doc_id)" for n in names)).count() == 0 < out.count()


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert [x for x, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "pii", "mixing", "packing"]
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns and kept.count() == sum(bool(re.search(r"[^\W\d_]", t or "")) for _, t in rows)
    left = corpus_pipeline.deduplicate(spark, kept, SF)
    near = brute_near([(r["doc_id"], r["text"]) for r in kept.collect()])
    assert {r["doc_id"] for r in left.collect()} == {d for d, x in near.items() if x[2]}
    clean = corpus_pipeline.pseudonyms(spark, left, SF)
    texts = {r["doc_id"]: r["text"] for r in left.collect()}
    assert {r["doc_id"]: r["text"] for r in clean.collect()} == {d: pii.pseudonymise(t, pii_key(spark))[0] for d, t in texts.items()}
    pieces = corpus_pipeline.run(spark, SF).collect()
    mixed = corpus_pipeline.mixture(spark, clean, SF).collect()
    assert check_pieces([(r["doc_id"], r["text"]) for r in mixed], pieces) == 0


def test_pipeline_takes_near_copies_from_80_percent(spark, docs):
    """Jaccard 0.796, 0.80 and 0.842 of five-word shingles: the last two are near copies in the stage."""
    import corpus_pipeline

    base = [f"w{i}" for i in range(400)]
    rows = [(1, " ".join(base))]
    for d, n in ((2, 45), (3, 44), (4, 34)):  # n words at the end are others, so n of 396 shingles are
        rows.append((d, " ".join([*base[: 400 - n], *(f"x{d}y{j}" for j in range(n))])))
    table = spark.createDataFrame([(d, t, "en", "a", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = {d for d, x in brute_near(rows, 80).items() if x[2]}
    assert left == {1, 2} and {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, table, "").collect()} == left
    near = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()], 80)
    assert {r["doc_id"] for r in corpus_pipeline.deduplicate(spark, docs, SF).collect()} == {d for d, x in near.items() if x[2]}


def test_pipeline_keeps_rows_with_null_and_repeated_doc_ids(spark):
    """Rows with null or equal doc_ids are documents of their own: near copies among them go, the others stay and are taken as often as the mix says."""
    import corpus_pipeline

    text = {c: " ".join(f"{c}{i}" for i in range(60)) for c in "abcdefg"}
    rows = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["c"]), (7, text["d"]), (8, text["d"]), (9, text["e"]), (None, text["e"]), (None, text["f"]), (None, text["f"]), (3, None), (3, "")]
    table = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.deduplicate(spark, table, "")
    want = [(None, text["a"]), (None, text["b"]), (7, text["c"]), (7, text["d"]), (9, text["e"]), (None, text["f"]), (3, None), (3, "")]
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == Counter(want)
    every = minhash.near_duplicates(table).collect()
    assert len(every) == len(rows) and sum(r["kept"] for r in every) == len(want)
    mixed = corpus_pipeline.mixture(spark, left, "")
    assert mixed.columns == table.columns
    # one source takes all its words once
    taken = Counter((r["doc_id"], w) for r in mixed.collect() for w in words(r["text"]))
    whole = Counter((d, w) for d, t in want for w in words(t))
    assert taken <= whole and sum((whole - taken).values()) <= mixing.BLOCK_WORDS


def test_pipeline_of_the_odd_table(spark, odd):
    """Every stage over nulls, empty texts and repeated rows: what one stage leaves, the next takes up."""
    import corpus_pipeline

    # the language stage has no classifier to learn from ten rows, so the others start from the whole table
    left = corpus_pipeline.deduplicate(spark, odd, "")
    want = Counter((r[0], r[1]) for r in ODD) - Counter([(6, ODD[5][1])] * 2)
    assert Counter((r["doc_id"], r["text"]) for r in left.collect()) == want
    clean = corpus_pipeline.pseudonyms(spark, left, "")
    assert Counter((r["doc_id"], r["text"]) for r in clean.collect()) == want
    mixed = corpus_pipeline.mixture(spark, clean, "").collect()
    assert all(r["text"] for r in mixed) and {r["doc_id"] for r in mixed} <= {d for d, _ in want}
    assert corpus_pipeline.language(spark, odd, "").columns == odd.columns
    again = spark.createDataFrame([(r["doc_id"], r["text"]) for r in mixed], "doc_id long, text string")
    assert check_pieces([(r["doc_id"], r["text"]) for r in mixed], corpus_pipeline.sequences(spark, again, "").collect()) == 0


def test_scratch_remainder(spark, docs):
    got = {r["doc_id"]: r["x"] for r in docs.select("doc_id", remainder(4).alias("x")).collect()}
    assert all(x == zlib.crc32(str(d).encode()) % 4 for d, x in got.items())
