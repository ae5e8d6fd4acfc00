"""Work on tables of few bytes and many rows or pairs: dealt over the cores, and done once for equal texts."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quern.functions import pairwise
from quern.functions import similarity as S
from quern.functions.text import tokens
from quern.operators import features, retrieval
from quern.plans import basics, linkage  # noqa: F401
from quern.plans.registry import QUERIES
from quern.runtime import stage
from quern.sources import adapter


def test_token_jaccard_of_a_large_group(spark, tmp_path):
    """One file holds groups whose pairs are dealt over several tasks; repeated, missing and empty names."""
    names = [None, "", "old ring", "ring old", "old bolt", "cold  plate", "plate"]
    rows = [(i, names[i % 7], "x" if i % 3 else "y", i % 8) for i in range(2400)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["token_jaccard"](spark, str(tmp_path))
    by = {}
    for i, n, b, s in rows:
        by.setdefault((b, s), []).append((i, n))
    words = lambda n: {w for w in (n or "").split(" ") if w}
    want = {(i, j): round(len(words(m) & words(n)) / len(words(m) | words(n)), 6) if words(m) and words(n) else 0.0 for g in by.values() for i, m in g for j, n in g if i < j}
    got = {(r["a"], r["b"]): r["jaccard"] for r in df.collect()}
    assert got == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") >= 2, "the pairs of names are compared first, then expanded to their parts"


def test_records_of_one_file_are_dealt_over_tasks(spark, tmp_path):
    spark.range(5000).withColumnRenamed("id", "c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert len(adapter.records(spark, str(tmp_path)).inputFiles()) > 1


def test_equal_names_are_compared_once(monkeypatch):
    """300 queries and 300 records of one name: each search forms one product of names, whatever the number of rows."""
    side = lambda p, n: pa.table({"country": ["us"] * n, "target": ["S2"] * n, "entity_id": [f"{p}-{i:03}" for i in range(n)], **{f"name_{x}": pa.array([v] * n) for x, v in (("grams", [1, 2]), ("w", [0.6, 0.8]))}, **{f"addr_{x}": pa.array([v] * n) for x, v in (("grams", [7]), ("w", [1.0]))}})
    cells, plain = [], retrieval.Postings.scores
    monkeypatch.setattr(retrieval.Postings, "scores", lambda self, lengths, grams, w, n: cells.append(len(lengths) * n) or plain(self, lengths, grams, w, n))
    out = retrieval._cell(side("S1", 300), side("S2", 300), 4, 2).to_pylist()
    assert sum(cells) <= 4
    assert {(r["s1"], r["m"]) for r in out if r["s1"] == "S1-200"} == {("S1-200", f"S2-{i:03}") for i in range(4)}
    assert {(r["s1"], r["m"]) for r in out if r["m"] == "S2-200"} == {(f"S1-{i:03}", "S2-200") for i in range(2)}
    assert all(r["cos_name"] == r["cos_addr"] == 1.0 for r in out)


def test_vectors_of_counts_equal_weights(spark):
    """Counting in Arrow gives the vectors that a row per gram gives, for odd texts too."""
    names = ["", "a", "acme  works", "acme works ltd", "éa 𝒳y", "acme acme", "works ltd", None]
    rows = [(f"S{1 + i % 3}-{i}", f"S{1 + i % 3}", "us" if i % 2 else "fr", names[i % 8], "", names[(i * 3 + 1) % 8] or "") for i in range(48)]
    rec = stage(spark.createDataFrame(rows, "entity_id string, src string, country string, name_norm string, name_domain string, addr_norm string"))
    got, want = ({(r["target"], r["entity_id"]): r for r in v.collect()} for v in (retrieval.text_vectors(rec, 0.6), retrieval.vectors(retrieval.weights(retrieval.corpus(rec), 0.6))))
    assert got.keys() == want.keys() and len(got)
    for key, r in got.items():
        for f in retrieval.FIELDS:
            assert r[f"{f}_grams"] == want[key][f"{f}_grams"]
            assert r[f"{f}_w"] == pytest.approx(want[key][f"{f}_w"], abs=1e-12)


def test_equal_texts_are_searched_up_to_k(monkeypatch):
    """300 queries and 300 records equal in both fields: exact scores are formed for the first k of them, not for all pairs."""
    side = lambda p: pa.table({"country": ["us"] * 300, "target": ["S2"] * 300, "entity_id": [f"{p}-{i:03}" for i in range(300)], **{f"{f}_{x}": pa.array([v] * 300) for f in ("name", "addr") for x, v in (("grams", [1, 2]), ("w", [0.6, 0.8]))}})
    scored, plain = [], retrieval.Dots.__call__
    monkeypatch.setattr(retrieval.Dots, "__call__", lambda self, row, col: scored.append(len(row)) or plain(self, row, col))
    out = retrieval._cell(side("S1"), side("S2"), 4, 2, frozenset(("addr", "comb", "rcomb"))).to_pylist()
    assert max(scored) <= 300 * (4 + 2)
    assert {(r["s1"], r["m"]) for r in out} == {(f"S1-{i:03}", f"S2-{j:03}") for i in range(300) for j in range(300) if j < 4 or i < 2}


def test_tiles_equal_brute_force(monkeypatch):
    """Small tiles, merges and limits of held pairs: the best of each row are those of all pairs, ties to the smaller id."""
    for name, value in (("TILE", 8), ("TILE_CELLS", 40), ("WAITING", 5), ("HELD", 20), ("DENSE", 0.02)):
        monkeypatch.setattr(retrieval, name, value)
    rng = np.random.default_rng(7)

    def texts(n, size):
        dense = rng.integers(1, 3, (n, size)) * (rng.random((n, size)) < 0.2)
        dense[rng.random(n) < 0.2] = 0
        dense[n // 2 :: 5] = dense[0]
        return dense / np.maximum(np.sqrt((dense**2).sum(1, keepdims=True)), 1e-9)

    both = {p: (n, texts(n, 12), texts(n, 40)) for p, n in (("S1", 61), ("S2", 83))}
    lists = lambda m: {"grams": [np.flatnonzero(v).tolist() for v in m], "w": [v[v > 0].tolist() for v in m]}
    typed = lambda x, v: pa.array(v, pa.list_(pa.int64() if x == "grams" else pa.float64()))
    side = lambda p: pa.table({"country": ["us"] * both[p][0], "target": ["S2"] * both[p][0], "entity_id": [f"{p}-{i:03}" for i in range(both[p][0])], **{f"{f}_{x}": typed(x, v) for f, m in zip(("name", "addr"), both[p][1:], strict=True) for x, v in lists(m).items()}})
    out = retrieval._cell(side("S1"), side("S2"), 4, 2).to_pylist()
    name, addr = (np.round(both["S1"][i] @ both["S2"][i].T, 9) for i in (1, 2))
    for x, score in (("name", name), ("addr", addr), ("comb", name + addr), ("rcomb", (name + addr).T), ("rname", name.T)):
        k, turned = (2, True) if x[0] == "r" else (4, False)
        best = lambda v: [int(j) for j in np.lexsort((np.arange(len(v)), -np.round(v, 8)))[:k] if v[j] > 0]  # noqa: B023, E731
        want = {(j, i) if turned else (i, j) for i, v in enumerate(score) for j in best(v)}
        got = {(int(r["s1"][3:]), int(r["m"][3:])) for r in out if r["found"] & retrieval.BITS[x]}
        assert len(got) and got == want, x


def test_texts_that_differ_in_rare_grams_are_multiplied_once():
    """300 texts of a few frequent parts, with other numbers each: a few rows are multiplied, and they give the products of the texts."""
    grams = [[1 + i % 3, 4, *range(100 + 2 * i, 100 + 2 * i + 1 + i % 4)] for i in range(300)]
    w = [np.arange(len(g), 0, -1) / np.sqrt((np.arange(len(g), 0, -1.0) ** 2).sum()) for g in grams]
    texts = np.array([len(g) for g in grams]), np.concatenate(grams), np.concatenate(w)
    dense = retrieval.frequent(texts, texts)
    assert dense[:4].tolist() == [1, 2, 3, 4]
    shapes = retrieval.Shapes(texts, np.array([1, 2, 3, 4]))
    flat = np.zeros((300, 5))
    for i, (g, x) in enumerate(zip(grams, w, strict=True)):
        flat[i, g[:2]] = x[:2]
    assert len(shapes.matrix) < 15
    got = (shapes.matrix @ shapes.matrix.T)[np.ix_(shapes.cls, shapes.cls)] * shapes.norm[:, None] * shapes.norm[None, :]
    assert np.abs(got - flat @ flat.T).max() < 1e-5
    assert shapes.rest[0].tolist() == [len(g) - 2 for g in grams]


def test_similarities_of_many_pairs_equal_those_of_one(monkeypatch):
    """Empty, short and long texts, repeated words and letters beyond the first plane, in pieces of few pairs."""
    rng = random.Random(3)
    monkeypatch.setattr(pairwise, "PAIRS", 50)
    text = lambda: "".join(rng.choice(rng.choice(("ab ", "abcdefgh ", "éx𝒳y "))) for _ in range(rng.choice((0, 1, 2, 5, 9, 20, 40))))
    left, right = [text() for _ in range(600)], [text() for _ in range(600)]
    left += ["ab c" * 70, "abc", "a" * 255, "martha", "abcd", "ab", ""]
    right += ["abc d" * 60, "ba c" * 70, "ab" * 128, "marhta", "abXcd", "cd", ""]
    at = np.arange(len(left))
    for name, one in (("ratio", S.ratio_text), ("partial", S.partial_text), ("jaro_winkler", S.jaro_winkler_text), ("token_set", S.token_set_text), ("token_sort", S.token_sort_text)):
        assert pairwise.FUNCTIONS[name](left, right, at, at).tolist() == [one(a, b) for a, b in zip(left, right, strict=True)], name


def test_string_features_of_a_batch(spark):
    """The string features and weighted overlaps of pairs come from one pass over batches and equal the expressions; a null text gives null."""
    texts = ["acme works ltd", "acme", "", None, "works  acme acme", "beta ring co", "12 mill rd ohio"]
    rows = [(f"S1-{i}", f"S2-{j}", texts[i], texts[j], texts[(i + j) % 7], texts[(i * j) % 7]) for i in range(7) for j in range(7)]
    names = {"l_name_norm": "a", "r_name_norm": "b", "l_name_core": "a", "r_name_core": "b", "r_name_alias": "c", "r_name_domain": "d", "l_addr_norm": "c", "r_addr_norm": "d"}
    weights = F.map_from_entries(F.transform(F.array_distinct(F.split(F.lit("acme works ltd beta ring co 12 mill rd ohio"), " ")), lambda t: F.struct(t, F.length(t) + 0.5)))
    of = lambda c: F.transform(F.array_sort(F.array_distinct(tokens(F.col(c)))), lambda t: F.try_element_at(weights, t))
    df = spark.createDataFrame(rows, "s1 string, m string, a string, b string, c string, d string").select("s1", "m", *[F.col(v).alias(k) for k, v in names.items()])
    wide = df.withColumns({f"{s}_{f}_idf": of(f"{s}_{c}") for s in "lr" for f, c in (("name", "name_core"), ("addr", "addr_norm"))})
    plain = df.withColumns({"l_idf_map": weights, "r_idf_map": weights})
    plain = plain.withColumns({k: v.cast("float") for k, v in (features.string_features() | features.idf_features(F.lit(9.0))).items()})
    got, want = ({(r["s1"], r["m"]): r.asDict() for r in x.collect()} for x in (features.with_wide_features(wide, True), plain))
    assert len(got) == 49
    for key, r in got.items():
        if None in [want[key][c] for c in names]:
            assert (r["nm_ratio"] is None) == (None in (want[key]["l_name_core"], want[key]["r_name_core"]))
        else:
            assert {c: r[c] for c in (*features.STRINGS, *features.OVERLAPS)} == {c: want[key][c] for c in (*features.STRINGS, *features.OVERLAPS)}, key


def test_pair_features_compare_in_batches(spark):
    plan = QUERIES["pair_features"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan, "no Python call per pair"


def test_owners_by_reverse_retrieval(spark, monkeypatch):
    """Over several blocks the owners are the best of all candidates, and flagship asks for no other retriever."""
    d, wanted, plain = "/root/testdata/sf0.001", [], retrieval.top_pairs
    rec = stage(linkage.normalized(spark, d))
    want = linkage.windows.best_owner(retrieval.candidates(rec).selectExpr("s1", "m", "(double(cos_name) + double(cos_addr)) / 2 AS p").filter("p >= 0.5"))
    got = retrieval.owners(retrieval.text_vectors(rec), 0.5, query_block=3, record_block=20)
    assert {tuple(r) for r in got.select("s1", "m", "p", "sure").collect()} == {(r["s1"], r["m"], r["p"], True) for r in want.collect()}
    monkeypatch.setattr(retrieval, "top_pairs", lambda *a, want, **b: wanted.append(want) or plain(*a, want=want, **b))
    QUERIES["flagship"](spark, d)
    assert wanted == [{"rcomb", "owner"}]


def test_owner_that_rounding_leaves_open(spark):
    """Seven names apart by 1e-9 are equal in single precision: the smallest id is the best, but not among the five nearest."""
    rows = [("us", "S2", f"S1-{i}", "S1", [1], [1 - 1e-9 * (7 - i)], [], []) for i in range(7)] + [("us", "S2", "S2-1", "S2", [1], [1.0], [], [])]
    rows += [("fr", "S2", f"S1-{i + 10}", "S1", [1], [0.99 - 0.01 * i], [], []) for i in range(7)] + [("fr", "S2", "S2-2", "S2", [1], [1.0], [2], [1.0])]
    rows += [("fr", "S2", "S1-20", "S1", [1], [0.9], [2], [0.5])]
    vecs = spark.createDataFrame(rows, "country string, target string, entity_id string, src string, name_grams array<long>, name_w array<double>, addr_grams array<long>, addr_w array<double>")
    got = {r["m"]: (r["s1"], r["sure"]) for r in retrieval.owners(vecs, 0.5).collect()}
    assert got == {"S2-1": ("S1-0", False), "S2-2": ("S1-20", True)}
