"""Files, validation, learned dictionaries, invariants of the matching flow and the model."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import features, matcher, resources, retrieval, sampling, validate, windows
from quern.plans.linkage import normalized
from quern.runtime import stage
from quern.sources import adapter, io

SF = "/root/testdata/sf0.001"


def test_tsv_readers(spark, tmp_path):
    d = tmp_path / "train"
    d.mkdir()
    for i in (1, 2, 3):
        (d / f"train_source{i}.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS%d-1\tA "quoted\t\tUS\nS%d-2\tNA\t1 Main\tUS\n' % (i, i))
    (d / "train_ground_truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    t = io.load_split(spark, f"file://{tmp_path}", "train")
    assert sorted(t) == ["gt", "s1", "s2", "s3"]
    assert {r["matched_entity_ids"] for r in t["gt"].collect()} == {"S2-1,S3-1", ""}
    rows = io.read_tsv(spark, f"file://{d}/train_source1.tsv", quoted=False).collect()
    assert [tuple(r) for r in rows] == [("S1-1", 'A "quoted', "", "US"), ("S1-2", "NA", "1 Main", "US")]
    audit = io.convert(spark, f"file://{d}/train_source1.tsv", f"file://{tmp_path}/out").first()
    assert (audit["n_rows"], audit["n_lines"]) == (2, 2)


def test_id_list_sink(spark, tmp_path):
    s1 = spark.createDataFrame([("S1-2", 0), ("S1-1", 1)], "source1_entity_id string, pos int")
    m = spark.createDataFrame([("S1-1", "S3-1", 0), ("S1-1", "S2-1", 1), ("S1-1", "S3-1", 2)], "s1 string, m string, pos int")
    path = f"file://{tmp_path}/lists"
    io.write_id_lists(io.id_lists(m, s1), path)
    text = next((tmp_path / "lists").glob("part-*")).read_text()
    assert text == "source1_entity_id\tmatched_entity_ids\nS1-2\t\nS1-1\tS3-1,S2-1\n"


@pytest.mark.parametrize(
    ("content", "rule"),
    [(None, "file_missing"), ("", "file_empty"), ("source1_entity_id,matched_entity_ids\n", "comma_header"), ("a\tb\n", "wrong_header")],
)
def test_fatal_headers(spark, tmp_path, content, rule):
    path = tmp_path / "r.tsv"
    if content is not None:
        path.write_text(content)
    code, report = validate.validate_file(spark, f"file://{path}", "matched_entity_ids", spark.createDataFrame([("S1-1",)], "s1 string"))
    assert code == 1 and [(r["severity"], r["rule"]) for r in report.collect()] == [("fatal", rule)]


def test_each_rule(spark, tmp_path):
    (tmp_path / "r.tsv").write_text(" Source1_Entity_ID \tMATCHED_entity_ids\nno tab\n\nS1-1\tS2-1,S2-1\nS1-1\t\nS1-2\tS1-9\nS1-3\tX-1\nS1-7\tS3-5\n")
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\n")
    required = spark.createDataFrame([(f"S1-{i}",) for i in range(1, 6)], "s1 string")
    known = spark.createDataFrame([("S2-1",)], "id string")
    code, report = validate.validate_file(spark, f"file://{tmp_path}/r.tsv", "matched_entity_ids", required, known, f"file://{tmp_path}/c.tsv")
    got = {r["rule"]: (r["n"], r["examples"]) for r in report.collect()}
    assert code == 1 and got == {
        "malformed_row": (1, "no tab"), "duplicate_s1": (1, "S1-1"), "duplicate_id": (1, "S1-1"), "self_match": (1, "S1-2"), "bad_prefix": (1, "S1-3"),
        "missing_s1": (2, "S1-4,S1-5"), "extra_s1": (1, "S1-7"), "unknown_id": (3, "S1-9,S3-5,X-1"), "not_a_candidate": (3, "S1-2,S1-3,S1-7"),
    }
    (tmp_path / "ok.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t\n" for i in range(1, 6)))
    assert validate.validate_file(spark, f"file://{tmp_path}/ok.tsv", "matched_entity_ids", required)[0] == 0


def test_learned_dictionaries(spark):
    states = resources.learn_states(spark.createDataFrame([("1 A St, Maharashtra", "1 A St, महाराष्ट्र")] * 5 + [("2 B St, Goa", "x, गोवा")] * 4, "s1_addr string, m_addr string"))
    assert [tuple(r) for r in states.collect()] == [("महाराष्ट्र", "mh")]
    tokens = resources.learn_tokens(spark.createDataFrame([("City Private", "सिटी प्राइवेट")] * 3, "s1_name string, m_name string"))
    learned = {r["key"]: r["value"] for r in tokens.collect()}
    assert learned["prvt"] == "private"
    df = spark.createDataFrame([("सिटी प्राइवेट", "")], "business_name string, business_address string")
    assert X.normalize_names(df, native_token=resources.as_map(tokens)).first()["name_norm"] == "city private"


def test_invariants(spark):
    rec = normalized(spark, SF)
    cand = stage(retrieval.candidates(rec))
    assert cand.groupBy("s1", "m").count().filter("count > 1").count() == 0
    src = cand.filter(~(F.col("s1").startswith("S1-") & (F.col("m").startswith("S2-") | F.col("m").startswith("S3-"))))
    assert src.count() == 0 and cand.filter("rank_name = 0 and rank_addr = 0 and rank_comb = 0 and rank_rcomb = 0 and rank_rname = 0").count() == 0
    scored = cand.select("s1", "m", ((F.col("cos_name") + F.col("cos_addr")) / 2).alias("p"))
    matched = windows.assign(scored, "p", 0.3).select("s1", F.explode("matched").alias("m"))
    assert matched.count() == matched.select("m").distinct().count() and matched.join(cand, ["s1", "m"], "left_anti").count() == 0
    # queries narrow the result after the reverse ranks are given
    few = rec.filter("src = 'S1'").select(F.col("entity_id").alias("s1")).orderBy("s1").limit(5)
    part = retrieval.candidates(rec, few)
    assert part.exceptAll(cand.join(few, "s1", "left_semi").select(*part.columns)).count() == 0


def test_features_and_two_pass_model(spark, tmp_path):
    rec = normalized(spark, SF)
    truth = adapter.true_pairs(spark, SF)
    cand = stage(retrieval.candidates(rec, k=5, k_reverse=2))
    f = features.labelled(features.pair_features(cand, rec), truth)
    numbers = [c for c in f.columns if c not in ("s1", "m", "label")]
    assert len(numbers) == 44 and f.count() == cand.count()
    rows = stage(sampling.split(f, "s1", validation=0.3))
    counts = rec.filter("src = 'S1'").select(F.col("entity_id").alias("s1")).join(truth.groupBy("s1").agg(F.count("*").alias("n_true")), "s1", "left").na.fill(0)
    model, out = matcher.train(rows, matcher.Params(rounds=3, depth=3, min_rows=5), counts)
    assert out.count() == cand.count() and 0.2 <= model.threshold <= 0.95
    assert len(matcher.second_columns(model.columns)) == 51
    model.save(f"file://{tmp_path}/model")
    again = matcher.TwoPass.load(f"file://{tmp_path}/model", model.columns, model.threshold)
    a, b = (sorted(map(tuple, m.match(rows.drop("fold", "label")).select("s1", F.array_join("matched", ",")).collect())) for m in (model, again))
    assert a == b
    assert sum(x[1] for x in matcher.importances(model.second, matcher.second_columns(model.columns), 60)) == pytest.approx(1.0, abs=1e-6)


def test_blocked_products_equal_all_pairs(spark, monkeypatch):
    """Small blocks, small score matrices and many ties give the same best pairs as all products of the weights."""
    rec = stage(normalized(spark, SF).limit(140))
    raw = stage(retrieval.weights(retrieval.corpus(rec)))
    w = retrieval.unit(raw).select("country", "target", "field", "entity_id", "src", "gram", "w").toPandas()
    sums = {}
    for (c, t, f, g), part in w.groupby(["country", "target", "field", "gram"]):
        q, r = part[part.src == "S1"], part[part.src != "S1"]
        for a, x in zip(q.entity_id, q.w, strict=True):
            for b, y in zip(r.entity_id, r.w, strict=True):
                sums.setdefault((c, t, a, b), {"name": 0.0, "addr": 0.0})[f] += x * y
    monkeypatch.setattr(retrieval, "CELLS", 64)
    monkeypatch.setattr(retrieval, "PRODUCTS", 50)
    pairs = retrieval.top_pairs(retrieval.vectors(raw), 4, 2, query_block=3, record_block=7)
    assert pairs.count() == pairs.select("s1", "m").distinct().count()
    for score, by, k in (("cos_name", "s1", 4), ("cos_addr", "s1", 4), ("cos_comb", "s1", 4), ("cos_comb", "m", 2), ("cos_name", "m", 2)):
        value = lambda v, s=score: round((round(v["name"], 9) + round(v["addr"], 9)) / 2, 10) if s == "cos_comb" else round(v[s[4:]], 9)
        groups = {}
        for (c, t, a, b), v in sums.items():
            if value(v) > 0:
                groups.setdefault((c, t, a if by == "s1" else b), []).append((-value(v), b if by == "s1" else a))
        want = {(key[2], other, i + 1) for key, rows in groups.items() for i, (_, other) in enumerate(sorted(rows)[:k])}
        got = {(r[by], r["m" if by == "s1" else "s1"], r["rank"]) for r in retrieval.retrieve(pairs, score, by, k, "rank").collect()}
        assert got == want, (score, by)


def test_header_of_three_columns_and_repeated_header(spark, tmp_path):
    required = spark.createDataFrame([("S1-1",)], "s1 string")
    (tmp_path / "a.tsv").write_text("source1_entity_id\tmatched_entity_ids\tscore\nS1-1\t\n")
    code, report = validate.validate_file(spark, f"file://{tmp_path}/a.tsv", "matched_entity_ids", required)
    assert code == 1 and report.first()["rule"] == "wrong_header"
    (tmp_path / "b.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\t\nsource1_entity_id\tmatched_entity_ids\n")
    code, report = validate.validate_file(spark, f"file://{tmp_path}/b.tsv", "matched_entity_ids", required)
    assert code == 1 and {r["rule"]: r["n"] for r in report.collect()}["extra_s1"] == 1


def test_draws_with_replacement(spark):
    rows = [("a", i) for i in range(300)] + [("b", 7)]
    drawn = sampling.with_replacement(spark.createDataFrame(rows, "k string, i long"), "k", "i", 40).collect()
    assert sorted((r["k"], r["draw"]) for r in drawn) == [(k, d) for k in "ab" for d in range(40)]
    assert {r["i"] for r in drawn if r["k"] == "b"} == {7} and len({r["i"] for r in drawn if r["k"] == "a"}) > 25
    again = sampling.with_replacement(spark.createDataFrame(rows[::-1], "k string, i long"), "k", "i", 40).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
