"""Data-quality profiles of records and pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.functions import tables as T
from quern.functions.text import tokens
from quern.operators import sampling

CUTOFF = 50


def rate(c: Column) -> Column:
    """Share of rows in percent, to four places."""
    return F.round(100.0 * F.avg(F.coalesce(c, F.lit(False)).cast("double")), 4)


def describe(df: DataFrame, numeric: list[str], flags: list[str], by: list[str]) -> DataFrame:
    """Overall and by group in one pass: n, mean, p10 and p50 of numbers, percent of flags. Overall rows have null groups."""
    cells = [F.count("*").alias("n")]
    for c in numeric:
        cells += [F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.percentile(c, F.lit(0.1)), 4).alias(f"{c}_p10"), F.round(F.percentile(c, F.lit(0.5)), 4).alias(f"{c}_p50")]
    cells += [rate(F.col(c)).alias(f"{c}_pct") for c in flags]
    return df.groupingSets([[F.col(c) for c in by], []], *by).agg(*cells)


def pair_similarities(pairs: DataFrame) -> DataFrame:
    """The 14 columns of the pair profile on pairs with both records' fields (l_, r_), raw and normalised."""
    c = F.col
    filled = lambda a, b: (c(a) == c(b)) & (c(a) != "")
    return pairs.withColumns({
        "name_raw_tsr": S.token_set_ratio(F.lower("l_business_name"), F.lower("r_business_name"), True),
        "name_norm_tsr": S.token_set_ratio(c("l_name_norm"), c("r_name_norm"), True),
        "name_core_tsr": S.token_set_ratio(c("l_name_core"), c("r_name_core"), True),
        "name_core_jac": S.token_jaccard(c("l_name_core"), c("r_name_core")),
        "name_core_exact": c("l_name_core") == c("r_name_core"),
        "addr_raw_tsr": S.token_set_ratio(F.lower("l_business_address"), F.lower("r_business_address"), True),
        "addr_norm_tsr": S.token_set_ratio(c("l_addr_norm"), c("r_addr_norm"), True),
        "addr_empty": c("r_addr_norm") == "",
        "house_eq": filled("l_addr_house", "r_addr_house"),
        "state_eq": filled("l_addr_state", "r_addr_state"),
        "state_missing": c("r_addr_state") == "",
        "is_translit": c("r_name_is_translit"),
        "has_alias": c("r_name_alias") != "",
        "legal_eq": c("l_name_legal") == c("r_name_legal"),
    })


def taxonomy(pairs: DataFrame, name: str, address: str, cutoff: float = CUTOFF) -> DataFrame:
    """Percent of pairs with strong or weak name and address similarity (a missing address counts as weak)."""
    strong_n, strong_a = F.col(name) >= cutoff, F.coalesce(F.col(address) >= cutoff, F.lit(False))
    return pairs.agg(
        F.count("*").alias("n"), rate(strong_n & strong_a).alias("both_strong"), rate(strong_n & ~strong_a).alias("name_only"),
        rate(~strong_n & strong_a).alias("address_only"), rate(~strong_n & ~strong_a).alias("both_weak"),
    )


def random_negatives(records: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """n seeded pairs (s1, m) per country; true pairs aren't taken out."""
    left = sampling.with_replacement(records.filter("src = 'S1'").select("country", F.col("entity_id").alias("s1")), "country", "s1", n, seed)
    right = sampling.with_replacement(records.filter("src <> 'S1'").select("country", F.col("entity_id").alias("m")), "country", "m", n, seed + 1)
    return left.join(right, ["country", "draw"])


def shared_names(records: DataFrame, name: str = "name_core") -> DataFrame:
    """n, percent of S1 whose name another S1 of the country has, number of names."""
    names = records.filter("src = 'S1'").groupBy("country", name).agg(F.count("*").alias("k"))
    shared = F.sum(F.when((F.col("k") > 1) & (F.col(name) != ""), F.col("k")).otherwise(0))
    return names.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.round(100.0 * F.try_divide(shared, F.sum("k")), 4).alias("shared_pct"), F.count("*").alias("n_names"))


def top_names(records: DataFrame, name: str = "name_core", n: int = 15) -> DataFrame:
    """The names that most S1 have, with how many."""
    return records.filter("src = 'S1'").groupBy(name).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name).limit(n)


def cluster_sizes(counts: DataFrame, by: str) -> DataFrame:
    """Number of matches of S1 (s1, n_true, ``by``) by group: n, mean, std, least, quartiles, most."""
    c = F.col("n_true")
    quartiles = [F.percentile(c, F.lit(p)).alias(f"p{int(100 * p)}") for p in (0.25, 0.5, 0.75)]
    return counts.groupBy(by).agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("least"), *quartiles, F.max(c).alias("most"))


def cluster_histogram(counts: DataFrame, truth: DataFrame, sources: tuple[str, ...] = ("S2", "S3")) -> DataFrame:
    """(src, size, n): how many S1 have ``size`` matches, in all and in each source."""
    of = truth.groupBy("s1").agg(*[F.sum((F.substring("m", 1, 2) == s).cast("bigint")).alias(s) for s in sources])
    wide = counts.select("s1", F.col("n_true").alias("all")).join(of, "s1", "left").na.fill(0)
    long = wide.select(F.inline(F.array(*[F.struct(F.lit(c).alias("src"), F.col(c).cast("bigint").alias("size")) for c in ("all", *sources)])))
    return long.groupBy("src", "size").agg(F.count("*").alias("n"))


def cluster(records: DataFrame, truth: DataFrame, s1: str) -> DataFrame:
    """The records of one S1 and of all its true matches."""
    ids = truth.filter(F.col("s1") == s1).select(F.col("m").alias("entity_id"))
    return records.filter(F.col("entity_id") == s1).unionByName(records.join(ids, "entity_id", "left_semi").select(*records.columns))


def singletons_by_legal(records: DataFrame, counts: DataFrame, top: int = 12) -> DataFrame:
    """Percent of S1 without a match by legal form, the ``top`` highest."""
    s1 = records.filter("src = 'S1'").select(F.col("entity_id").alias("s1"), F.when(F.col("name_legal") == "", F.lit("<none>")).otherwise(F.col("name_legal")).alias("name_legal"))
    return s1.join(counts, "s1").groupBy("name_legal").agg(F.count("*").alias("n"), rate(F.col("n_true") == 0).alias("singleton_pct")).orderBy(F.desc("singleton_pct"), "name_legal").limit(top)


def distractors(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Records outside S1 that match nothing: per source, how many and what their fields look like."""
    other = records.filter("src <> 'S1'")
    flags = other.join(truth.select(F.col("m").alias("entity_id"), F.lit(True).alias("matched")).distinct(), "entity_id", "left")
    c, lone = F.col, F.col("matched").isNull()
    share = lambda x: F.round(100.0 * F.try_divide(F.sum((lone & x).cast("int")), F.sum(lone.cast("int"))), 4)
    return flags.groupBy("src").agg(
        F.count("*").alias("n"), F.sum(lone.cast("int")).cast("bigint").alias("n_lone"), rate(lone).alias("lone_pct"),
        share(c("addr_norm") == "").alias("no_address_pct"), share(c("addr_state") == "").alias("no_state_pct"), share(c("addr_house") == "").alias("no_house_pct"),
        share(c("name_core") == "").alias("no_name_pct"), share(c("name_legal") != "").alias("legal_pct"), share(c("name_alias") != "").alias("alias_pct"),
        share(c("name_domain") != "").alias("domain_pct"), share(c("name_is_translit")).alias("translit_pct"),
    )


def singletons(records: DataFrame, counts: DataFrame, most: int = 7) -> DataFrame:
    """Percent of S1 without a match by number of name tokens (capped)."""
    s1 = records.filter("src = 'S1'").select(F.col("entity_id").alias("s1"), F.least(F.size(tokens(F.col("name_core"))), F.lit(most)).alias("n_tokens"))
    return s1.join(counts, "s1").groupBy("n_tokens").agg(F.count("*").alias("n"), rate(F.col("n_true") == 0).alias("singleton_pct"))


def token_frequency(records: DataFrame, column: str, country: str, top: int = 40) -> DataFrame:
    words = records.filter(F.col("country") == country).select(F.explode(tokens(F.col(column))).alias("token"))
    return words.groupBy("token").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "token").limit(top)


def source_profile(records: DataFrame) -> DataFrame:
    """Per source and country: rows and rates of missing and special fields."""
    c = F.col
    return records.groupBy("src", "country").agg(
        F.count("*").alias("n"), rate(c("name_core") == "").alias("name_empty"), rate(c("addr_norm") == "").alias("addr_empty"), rate(c("addr_state") == "").alias("state_missing"),
        rate(c("addr_house") != "").alias("has_house"), rate(c("addr_postcode") != "").alias("has_postcode"), rate(c("name_legal") != "").alias("has_legal"),
        rate(c("name_domain") != "").alias("has_domain"), rate(c("name_is_translit")).alias("translit"), F.countDistinct("name_core").alias("n_cores"),
        F.round(F.avg(F.length("name_norm")), 4).alias("name_len"),
    )


def integrity(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Truth rows, records with more than one S1, pairs across countries, percent of records outside S1 without a match."""
    country = records.select(F.col("entity_id").alias("m"), F.col("country").alias("mc"))
    own = records.select(F.col("entity_id").alias("s1"), F.col("country").alias("sc"))
    pairs = truth.select("s1", "m").join(country, "m").join(own, "s1")
    owners = pairs.groupBy("m").agg(F.countDistinct("s1").alias("k"), F.count("*").alias("n"), F.sum((F.col("mc") != F.col("sc")).cast("int")).alias("x"))
    a = owners.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("n_pairs"), F.coalesce(F.sum((F.col("k") > 1).cast("int")), F.lit(0)).cast("bigint").alias("n_shared"), F.coalesce(F.sum("x"), F.lit(0)).cast("bigint").alias("n_cross"), F.count("*").alias("n_m"))
    b = records.filter("src <> 'S1'").agg(F.count("*").alias("n_other"))
    return a.join(F.broadcast(b)).select("n_pairs", "n_shared", "n_cross", F.round(100.0 * F.try_divide(F.col("n_other") - F.col("n_m"), "n_other"), 4).alias("lone_pct"))


def noise(records: DataFrame) -> DataFrame:
    """Per source, percent of names that show a kind of noise; the patterns are our own."""
    n = F.col("business_name")
    kinds = {
        "upper": n.rlike(r"\p{Lu}") & (F.upper(n) == n), "lower": n.rlike(r"\p{Ll}") & (F.lower(n) == n), "digit_in_word": n.rlike(r"[A-Za-z][0-9]+[A-Za-z]"),
        "accent": n.rlike("[À-ÿ]"), "indic": n.rlike(T.INDIC), "domain": n.rlike(T.DOMAIN), "alias": n.rlike(T.ALIAS), "pipe": F.contains(n, F.lit("|")),
        "ampersand": F.contains(n, F.lit("&")), "double_space": F.contains(n, F.lit("  ")), "symbols": n.rlike(r"[#$%*!]{2,}"),
    }
    return records.groupBy("src").agg(F.count("*").alias("n"), *[rate(v).alias(k) for k, v in kinds.items()])
