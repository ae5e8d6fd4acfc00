"""Queries on whole texts and large blocks, against brute force on small tables."""

from __future__ import annotations

import pytest

from quern.plans import basics, linkage  # noqa: F401
from quern.plans.registry import QUERIES
from quern.sources import adapter

SF = "/root/testdata/sf0.001"


def write(spark, folder, rows, name="documents", schema="doc_id long, text string, lang string") -> str:
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture
def blocks(monkeypatch):
    """30 rows in S1 and 60 in S2 and S3 under one first word."""
    def records(spark, d):
        rows = [(f"S{1 + i % 3}-{i}", f"acme works{i}", f"{i} high street", "us", f"S{1 + i % 3}") for i in range(90)]
        return spark.createDataFrame(rows, "entity_id string, business_name string, business_address string, country string, src string")

    monkeypatch.setattr(adapter, "records", records)
    monkeypatch.setattr(adapter, "true_pairs", lambda spark, d: spark.createDataFrame([("S1-0", "S2-1", "us")], "s1 string, m string, country string"))
    return SF


def test_blocks_of_more_than_forty_rows(spark, blocks):
    want = {(f"S1-{a}", f"S{1 + b % 3}-{b}") for a in range(0, 90, 3) for b in range(90) if b % 3}
    for name in ("block_first", "block_union", "sim_ratio", "sim_partial", "field_eq", "idf_overlap"):
        rows = QUERIES[name](spark, blocks).collect()
        assert len(rows) == len(want) and {(r["s1"], r["m"]) for r in rows} == want, name
    assert QUERIES["block_oversize"](spark, blocks).count() == 0
    report = QUERIES["block_report_first"](spark, blocks).first()
    assert (report["n_pairs"], report["max_block"], report["dropped_s1_pct"]) == (1800, 60, 0.0)


def test_pair_features_of_all_candidates(spark):
    want = {(r["s1"], r["m"]) for r in QUERIES["candidates"](spark, SF).select("s1", "m").collect()}
    assert {(r["s1"], r["m"]) for r in QUERIES["pair_features"](spark, SF).select("s1", "m").collect()} == want


def test_text_functions_read_whole_texts(spark, tmp_path):
    long = "0" * 250 + " Straße & Été"
    d = write(spark, tmp_path, [(6, long, "en"), (7, "null" + " " * 20 + "x", "en"), (8, "- " * 200, "en"), (5, "a" * 40 + " dba end", "en")])
    found = {n: {r["doc_id"]: r for r in QUERIES[n](spark, d).collect()} for n in ("script_first_letter", "clean_text", "fold_accents", "null_tokens", "alias_split")}
    assert {i: found["script_first_letter"][i]["script"] for i in (6, 8)} == {6: "LATIN", 8: "NONE"}
    assert found["clean_text"][6]["clean"] == "0" * 250 + " Straße and Été"
    assert found["fold_accents"][6]["folded"] == "0" * 250 + " strasse & ete"
    assert not found["null_tokens"][7]["is_null"]
    assert found["alias_split"][5]["n_parts"] == 3 and found["alias_split"][5]["first_part"].strip() == "a" * 12
