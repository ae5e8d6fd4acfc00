"""Literal cases of names, addresses, skeletons, scores, F0.5 and windows."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.functions import text as X
from quern.operators import metrics, windows

NAMES = [
    ("Cabrera 5ecure Sciences LP", "cabrera secure sciences lp", "cabrera secure sciences", "lp", "", ""),
    ("Jaxaria Formerly Cabrera Secure Sciences", "cabrera secure sciences", "cabrera secure sciences", "", "jaxaria", ""),
    ("emerakeystonecom", "emerakeystone", "emerakeystone", "", "", "emerakeystone"),
    ("Elite  + C0mpany", "elite and company", "elite", "co", "", ""),
    ("Lawrence Venmfes Private (Limited)", "lawrence venmfes private limited", "lawrence venmfes", "ltd pvt", "", ""),
    ("-- Holloway Peak Inc Seafood", "holloway peak inc seafood", "holloway peak seafood", "inc", "", ""),
    ("ipower.com", "ipower", "ipower", "", "", "ipower"),
    ("meridian.com Enterprises", "enterprises", "enterprises", "", "", "meridian"),
    ("dba Orchard Ltd", "dba orchard ltd", "dba orchard", "ltd", "", ""),
    ("The Bank of A & B Co", "the bank of a and b co", "bank a b", "co", "", ""),
    ("Foo-Bar.co.in Pvt Ltd", "pvt ltd", "", "ltd pvt", "", "foobar"),
    ("Maison Àzar SASU", "maison azar sasu", "maison azar", "sasu", "", ""),
    ("NULL", "", "", "", "", ""),
    (None, "", "", "", "", ""),
]
ADDRESSES = [
    ("00709 Hackberry Saint, Tilden, Texas", "709 hackberry st tilden", "tx", "709", "", "709", 3),
    ("1344 MCDONALD HILL ROAD, CHILLICTHE CDP, OH", "1344 mcdonald hill rd chillicthe", "oh", "1344", "", "1344", 3),
    ("165 Barren River Drive, # UNIT 2, Erlanger Ky, Kentucky", "165 barren river dr 2 erlanger", "ky", "165 2", "", "165", 4),
    ("DL, North West, No C-956 Jd-36b, New Delhi", "n w c 956 jd 36b new delhi", "dl", "956 36b", "", "956", 4),
    ("12 Main Street, null, Goa", "12 main st", "ga", "12", "", "12", 2),
    ("5300 Wisconsin Avenue, Washington, District of Columbia", "5300 wisconsin ave", "wa", "5300", "", "5300", 3),
    ("Rue 5, 59000 Lille, Nord", "r 5 59000 lille", "hdf", "5 59000", "59000", "5", 3),
    ("26th Street 14A, Bombay 400001, Maharashtra", "26th st 14a mumbai 400001", "mh", "26 14a 400001", "400001", "26", 3),
    ("Texas", "", "tx", "", "", "", 1),
    ("TX", "tx", "", "", "", "", 1),
    ("NULL", "", "", "", "", "", 0),
    (None, "", "", "", "", "", 0),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n[0]) for i, n in enumerate(NAMES)], "i int, business_name string")
    got = {r["i"]: tuple(r)[1:] for r in X.normalize_names(df).select("i", "name_norm", "name_core", "name_legal", "name_alias", "name_domain").collect()}
    assert got == {i: n[1:] for i, n in enumerate(NAMES)}


def test_addresses(spark):
    df = spark.createDataFrame([(i, a[0]) for i, a in enumerate(ADDRESSES)], "i int, business_address string")
    got = {r["i"]: tuple(r)[1:] for r in X.normalize_addresses(df).select("i", "addr_norm", "addr_state", "addr_numbers", "addr_postcode", "addr_house", "addr_ncomp").collect()}
    assert got == {i: a[1:] for i, a in enumerate(ADDRESSES)}


def test_native_script(spark):
    df = spark.createDataFrame([("सिटी प्राइवेट", "12 Main Road, महाराष्ट्र"), ("Ácme", "x")], "business_name string, business_address string")
    native_token, native_state = F.create_map(F.lit("prvt"), F.lit("private")), F.create_map(F.lit("महाराष्ट्र"), F.lit("mh"))
    r = X.normalize(df, native_token, native_state).collect()
    one = next(x for x in r if x["name_is_translit"])
    assert one["name_script"] == "DEVANAGARI" and one["name_legal"] == "pvt" and one["addr_state"] == "mh" and one["addr_has_native"] and one["addr_norm"] == "12 main rd"
    assert X.romanize_text("प्राइवेट") == "praaivett" and X.fold_text("Straße №1 ÆØ é") == "strasse no1 aeo e"


def test_skeletons(spark):
    words = {"praaivett": "prvt", "limited": "lmtd", "marketing": "mrktng", "phone": "fn", "address": "adrs", "wholesale": "vhlsl", "quartz": "krtj"}
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert {r["w"]: r["s"] for r in df.select("w", X.squash_phonetic(F.col("w")).alias("s")).collect()} == words


SCORES = [("ci malt", "ci services", 33.333333, 44.444444), ("meridian", "enterprises", 31.578947, 31.578947), ("kfc consulting", "kfc service", 48.0, 48.0), ("a b", "a b c", 75.0, 100.0), ("", "", 100.0, 0.0), ("x", "", 0.0, 0.0)]


def test_scores(spark):
    df = spark.createDataFrame([s[:2] for s in SCORES], "a string, b string")
    got = [tuple(r) for r in df.select("a", "b", F.round(S.ratio(F.col("a"), F.col("b"), True), 6), F.round(S.token_set_ratio(F.col("a"), F.col("b"), True), 6)).collect()]
    assert sorted(got) == sorted(SCORES)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_ratio_random_lengths(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choices("abcé d", k=n)), "".join(rng.choices("abcé d", k=m))) for n in (0, 1, 5, 30, 61, 62, 63, 64, 90) for m in (0, 3, 62, 63, 64, 120)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", S.ratio(F.col("a"), F.col("b"), True).alias("r"), S.ratio(F.col("a"), F.col("b")).alias("j")).collect():
        want = 200.0 * plain_lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 100.0
        assert r["r"] == pytest.approx(want) and (r["j"] is None) == (min(len(r["a"]), len(r["b"])) > 62)


def test_partial_and_jaro_winkler():
    assert S.partial_text("abc", "xxabcxx") == 100.0 and S.partial_text("", "") == 100.0 and S.partial_text("a", "") == 0.0
    assert S.partial_text("abcd", "abXcd") == pytest.approx(max(S.ratio_text("abcd", w) for w in ("a", "ab", "abX", "abXc", "bXcd", "Xcd", "cd", "d")))
    assert S.jaro_winkler_text("martha", "marhta") == pytest.approx(0.961111, abs=1e-6) and S.jaro_winkler_text("", "") == 1.0


def test_f05_cases(spark):
    cases = [(2, 3, 2, 0.714286), (4, 4, 4, 1.0), (2, 2, 4, 0.833333), (4, 5, 4, 0.833333), (4, 6, 4, 0.714286), (1, 1, 4, 0.625), (0, 0, 4, 0.0), (0, 0, 0, 1.0), (0, 1, 0, 0.0)]
    df = spark.createDataFrame([c[:3] for c in cases], "tp long, n long, t long")
    got = [tuple(r) for r in df.select("tp", "n", "t", F.round(metrics.f05(F.col("tp"), F.col("n"), F.col("t")), 6)).collect()]
    assert sorted(got) == sorted(cases)


def test_windows(spark):
    df = spark.createDataFrame([("A", "x", 9.0), ("A", "y", 9.0), ("A", "z", 4.0), ("B", "x", 5.0)], "m string, s1 string, p double")
    got = sorted(tuple(r) for r in df.select("m", "s1", windows.rank_in_group("p", "m"), windows.gap_to_best("p", "m"), windows.second_best("p", "m"), windows.margin("p", "m"), windows.group_size("m")).collect())
    assert got == [("A", "x", 1, 0.0, 9.0, 0.0, 3), ("A", "y", 1, 0.0, 9.0, 0.0, 3), ("A", "z", 3, 5.0, 9.0, -5.0, 3), ("B", "x", 1, 0.0, -1.0, 6.0, 1)]


def test_normal_forms_letter_by_letter(spark):
    """The tables of letters and the texts that go through Python, against the definitions."""
    rng = random.Random(3)
    alphabet = [chr(i) for i in (*range(32, 127), *X.LATIN_CODES, *X.INDIC_CODES, *range(0x300, 0x320), 0x3B1, 0x3A3, 0x4E00, 0xFF21, 0x1F600)]
    safe = [chr(i) for i in X._ALONE]
    words = alphabet + ["".join(rng.choices(source, k=rng.randint(0, 12))) for source in (alphabet, safe) for _ in range(500)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    out = X.prepared(df, f=("fold", "w"), n=("nfkc", "w")).withColumns({"r": X.romanize(F.col("w")), "g": X.fold(F.col("w")), "plain": F.col("w").rlike(X.BY_LETTER)}).collect()
    assert len(out) == len(words) and 500 < sum(r["plain"] for r in out) < len(words)
    for r in out:
        assert (r["f"], r["g"], r["n"], r["r"]) == (X.fold_text(r["w"]), X.fold_text(r["w"]), unicodedata.normalize("NFKC", r["w"]), X.romanize_text(r["w"])), ascii(r["w"])
