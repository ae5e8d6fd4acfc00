"""Queries on scans, sinks, scalar text functions, joins, aggregates, windows, sorting, sampling and sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import similarity as S
from quern.functions import tables as T
from quern.functions import text as X
from quern.operators import sampling, windows
from quern.operators.features import token_idf
from quern.operators.metrics import majority
from quern.plans import sqltext as Q
from quern.plans.registry import query
from quern.runtime import scratch_root, small, spread, stage, table
from quern.sources import adapter, io

REC = f"WITH {adapter.SQL}\n"


# scans and sinks


@query("SELECT doc_id, lang FROM documents WHERE lang = 'fr'")
def scan_project(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter("lang = 'fr'").select("doc_id", "lang")


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def scan_full(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer")


@query("SELECT count(*) AS n_rows, count(*) AS n_lines FROM customer")
def row_audit(spark: SparkSession, d: str) -> DataFrame:
    base = f"{scratch_root(spark)}/quern/{uuid.uuid4().hex}"
    c = table(spark, d, "customer").select("c_name", "c_mktsegment")
    c.write.option("sep", "\t").option("header", True).option("quote", "").csv(f"{base}/tsv")
    # Spark writes a header into each file of a folder, so lines are counted without them
    parsed = io.read_tsv(spark, f"{base}/tsv", ("c_name", "c_mktsegment"), quoted=False).agg(F.count("*").alias("n_rows"))
    lines = spark.read.text(f"{base}/tsv").filter("value <> 'c_name\tc_mktsegment'").agg(F.count("*").alias("n_lines"))
    return parsed.join(F.broadcast(lines))


@query("SELECT o_custkey AS s1, string_agg(o_orderkey, ',' ORDER BY o_orderkey) AS ids FROM orders GROUP BY 1")
def idlist_build(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s1")).agg(F.array_sort(F.collect_list("o_orderkey")).alias("l"))
    return o.select("s1", F.array_join(F.transform("l", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT o_custkey AS s1, CAST(o_orderkey AS VARCHAR) AS m FROM orders")
def idlist_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return idlist_build(spark, d).select("s1", F.explode(X.parse_id_list(F.col("ids"))).alias("m"))


@query("SELECT c_custkey AS source1_entity_id, coalesce(string_agg(o_orderkey, ',' ORDER BY o_orderkey), '') AS matched_entity_ids FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1")
def id_lists_for_all(spark: SparkSession, d: str) -> DataFrame:
    s1 = table(spark, d, "customer").select(F.col("c_custkey").alias("source1_entity_id"), F.col("c_custkey").alias("pos"))
    m = table(spark, d, "orders").select(F.col("o_custkey").alias("s1"), F.col("o_orderkey").cast("string").alias("m"), F.col("o_orderkey").alias("pos"))
    return io.id_lists(m, s1).drop("pos")


@query("SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders")
def distinct_ids(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_root(spark)}/quern/{uuid.uuid4().hex}"
    table(spark, d, "orders").select("o_custkey", "o_orderkey").write.option("sep", "\t").option("header", True).csv(path)
    return io.read_ids(spark, path)


@query("SELECT n_name AS key, r_name AS value FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = f"{scratch_root(spark)}/quern/{uuid.uuid4().hex}"
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    io.write_json(n.select(F.col("n_name").alias("key"), F.col("r_name").alias("value")), path)
    return io.read_json(spark, path, "key string, value string")


# scalar text functions

WORDS = "words AS (SELECT item_id, i, w FROM (SELECT item_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM benchmark))"


def bench_words(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", " ")).alias("i", "w")).withColumn("i", (F.col("i") + 1).cast("bigint"))


def nullish(rest: str) -> str:
    return f"CASE doc_id % 9 WHEN 0 THEN 'N/A' WHEN 1 THEN ' null ' WHEN 2 THEN '' WHEN 3 THEN '--' WHEN 4 THEN NULL WHEN 5 THEN '<NULL>' ELSE {rest} END"


@query(f"SELECT doc_id, {Q.null_test('x')} AS is_null FROM (SELECT doc_id, {nullish('text')} AS x FROM documents)")
def null_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.expr(nullish("text")).alias("x")).select("doc_id", X.is_null(F.col("x")).alias("is_null"))


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '\\p{L}') THEN 'LATIN' ELSE 'NONE' END AS script FROM documents")
def script_first_letter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.script_of(F.col("text")).alias("script"))


@query(f"SELECT doc_id, {Q.cleaned('text')} AS clean FROM documents")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query(f"SELECT doc_id, {Q.folded('text')} AS folded FROM documents")
def fold_accents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.fold(F.col("text")).alias("folded"))


@query(f"WITH {WORDS}, s AS (SELECT item_id, i, {Q.skeleton('w')} AS t FROM words) SELECT item_id, CAST(i AS BIGINT) AS i, substr(t, 1, 1) || regexp_replace(substr(t, 2), '[aeiouy]', '', 'g') AS skeleton FROM s")
def phonetic_skeleton(spark: SparkSession, d: str) -> DataFrame:
    return bench_words(spark, d).select("item_id", "i", X.squash_phonetic(F.col("w")).alias("skeleton"))


@query(f"WITH {WORDS}, s AS (SELECT item_id, i, CASE WHEN i % 3 = 0 THEN translate(w, 'oes', '035') ELSE w || (i % 10) END AS t FROM words) SELECT item_id, CAST(i AS BIGINT) AS i, {Q.repaired('t')} AS fixed FROM s")
def ocr_repair(spark: SparkSession, d: str) -> DataFrame:
    t = F.when(F.col("i") % 3 == 0, F.translate("w", "oes", "035")).otherwise(F.concat("w", (F.col("i") % 10).cast("string")))
    return bench_words(spark, d).select("item_id", "i", X.fix_ocr_token(t).alias("fixed"))


@query(f"SELECT page_id, replace(regexp_extract(url, {Q.literal(T.DOMAIN)}, 1), '-', '') AS stem FROM pages")
def domain_stem(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", X.domain_stem(F.col("url")).alias("stem"))


def aliased(rest: str) -> str:
    return f"concat(substr(text, 1, 12), CASE doc_id % 5 WHEN 0 THEN ' dba ' WHEN 1 THEN ' d / b / a ' WHEN 2 THEN ' Formerly Known As ' WHEN 3 THEN ' t/a ' ELSE ' ' END, {rest})"


@query(f"SELECT doc_id, CAST(len(p) AS INTEGER) AS n_parts, p[1] AS first_part FROM (SELECT doc_id, list_filter(string_split_regex({aliased('substr(text, 13)')}, {Q.literal(T.ALIAS)}), lambda x: regexp_matches(x, '\\S')) AS p FROM documents)")
def alias_split(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "documents").select("doc_id", X.alias_parts(F.expr(aliased("substr(text, 13)"))).alias("p"))
    return p.select("doc_id", F.size("p").alias("n_parts"), F.get("p", F.lit(0)).alias("first_part"))


COMPANY = "concat(p_name, CASE p_partkey % 6 WHEN 0 THEN ' Inc' WHEN 1 THEN ' Private Limited' WHEN 2 THEN ' & Co' WHEN 3 THEN ' dba The Works LLC' WHEN 4 THEN '.com Ltd' ELSE '' END)"
PARTS = f"parts AS (SELECT p_partkey, {COMPANY} AS business_name FROM part)"
NAME_COLUMNS = ("name_norm", "name_core", "name_legal", "name_alias", "name_domain")


@query(f"WITH {PARTS}, {Q.names('parts', 'business_name')} SELECT p_partkey, {', '.join(NAME_COLUMNS)} FROM n6")
def legal_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select("p_partkey", F.expr(COMPANY).alias("business_name"))
    return X.normalize_names(rows).select("p_partkey", *NAME_COLUMNS)


@query(f"WITH {Q.NORM} SELECT entity_id, name_norm, name_core, name_legal, name_alias, name_domain, name_is_translit FROM norm")
def normalize_names(spark: SparkSession, d: str) -> DataFrame:
    return X.normalize_names(adapter.records(spark, d)).select("entity_id", *NAME_COLUMNS, "name_is_translit")


ADDRESS = (
    "concat(CASE WHEN l_orderkey % 2 = 0 THEN '00' ELSE '' END, l_orderkey, CASE l_linenumber % 4 WHEN 0 THEN ' Hackberry Saint' WHEN 1 THEN ' Barren River Drive, # UNIT 2' WHEN 2 THEN ' Rue 5' ELSE ' Marg Road, null' END, "
    "CASE l_partkey % 4 WHEN 0 THEN ', Chillicthe CDP, OH' WHEN 1 THEN ', Bombay 400001, Maharashtra' WHEN 2 THEN ', Erlanger ky, Kentucky' ELSE ', Nord.' END)"
)
LINES = f"addr AS (SELECT l_orderkey, l_linenumber, {ADDRESS} AS business_address FROM lineitem)"
ADDRESS_COLUMNS = ("addr_norm", "addr_state", "addr_numbers", "addr_postcode", "addr_house")


@query(f"WITH {LINES}, {Q.addresses('addr', 'business_address')} SELECT l_orderkey, l_linenumber, {', '.join(ADDRESS_COLUMNS)}, CAST(addr_ncomp AS INTEGER) AS addr_ncomp FROM a6")
def addr_components(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.expr(ADDRESS).alias("business_address"))
    return X.normalize_addresses(rows).select("l_orderkey", "l_linenumber", *ADDRESS_COLUMNS, "addr_ncomp")


@query(f"WITH {Q.NORM} SELECT entity_id, {', '.join(ADDRESS_COLUMNS)}, CAST(addr_ncomp AS INTEGER) AS addr_ncomp, addr_has_native FROM norm")
def normalize_addresses(spark: SparkSession, d: str) -> DataFrame:
    return X.normalize_addresses(adapter.records(spark, d)).select("entity_id", *ADDRESS_COLUMNS, "addr_ncomp", "addr_has_native")


@query(f"WITH {Q.NORM} SELECT entity_id, trim(CASE WHEN name_domain <> '' AND NOT contains(replace(name_norm, ' ', ''), name_domain) THEN name_norm || ' ' || name_domain ELSE name_norm END) AS name_text FROM norm")
def name_text(spark: SparkSession, d: str) -> DataFrame:
    n = X.normalize_names(adapter.records(spark, d))
    return n.select("entity_id", X.name_text(F.col("name_norm"), F.col("name_domain")).alias("name_text"))


@query(f"SELECT item_id, g AS gram, count(*) AS n FROM (SELECT item_id, unnest({Q.trigrams('text')}) AS g FROM benchmark) GROUP BY 1, 2")
def char_trigrams(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "benchmark").select("item_id", F.explode(X.char_trigrams(F.col("text"))).alias("gram"))
    return g.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("SELECT a.p_partkey AS a, b.p_partkey AS b, round(coalesce(CAST(len(list_intersect(string_split(a.p_name, ' '), string_split(b.p_name, ' '))) AS DOUBLE) / nullif(len(list_distinct(string_split(a.p_name || ' ' || b.p_name, ' '))), 0), 0), 6) AS jaccard FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey")
def token_jaccard(spark: SparkSession, d: str) -> DataFrame:
    """The names of one brand and size are compared once each; their parts are then paired, each left name's with all right ones'."""
    group = ["p_brand", "p_size", "part"]
    names = table(spark, d, "part").groupBy(*group[:2], "p_name").agg(F.collect_list("p_partkey").alias("ids"))
    names = stage(names.withColumn("part", F.pmod(F.xxhash64("p_name"), F.lit(PARTS))))
    every = names.withColumn("part", F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(PARTS)])))
    a, b = (spread(t.select(*group, F.col("p_name").alias(f"n{k}"), F.col("ids").alias(f"ids{k}")), *group) for t, k in ((names, "a"), (every, "b")))
    pairs = a.join(b, group).select("idsa", "idsb", F.coalesce(F.round(S.token_jaccard(F.col("na"), F.col("nb")), 6), F.lit(0.0)).alias("jaccard"))
    return pairs.select("idsb", "jaccard", F.explode("idsa").alias("a")).select("a", F.explode("idsb").alias("b"), "jaccard").filter("a < b")


#: The left names of a brand and size are dealt over so many parts, each joined with all right ones.
PARTS = 4


# joins

SPLIT_SQL = "CASE WHEN ('0x' || substr(md5(s1 || '42'), 1, 8))::BIGINT < 429496729 THEN 'val' ELSE 'train' END"


@query(f"{REC} SELECT s1, m, {SPLIT_SQL} AS fold FROM truth")
def pairs_with_split(spark: SparkSession, d: str) -> DataFrame:
    s1 = adapter.records(spark, d).filter("src = 'S1'").select(F.col("entity_id").alias("s1"))
    return adapter.true_pairs(spark, d).select("s1", "m").join(sampling.split(s1, "s1"), "s1")


@query("SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_mktsegment = 'BUILDING'")
def lookup_left(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey", "c_name")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "c_name")


@query("SELECT l_orderkey, l_linenumber, p_name FROM lineitem JOIN part ON l_partkey = p_partkey")
def lookup_inner(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select("p_partkey", "p_name")
    return table(spark, d, "lineitem").join(p, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "p_name")


EDGES = "edges AS (SELECT l_partkey AS s1, l_suppkey AS m, max(l_extendedprice) AS p, max(l_quantity) AS q FROM lineitem GROUP BY 1, 2)"


def edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("m")).agg(F.max("l_extendedprice").alias("p"), F.max("l_quantity").alias("q"))


@query(
    f"WITH {EDGES}, a AS (SELECT s1, m, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS r FROM edges QUALIFY r <= 5), b AS (SELECT s1, m, row_number() OVER (PARTITION BY m ORDER BY q DESC, p DESC, s1) AS r FROM edges QUALIFY r <= 5) "
    "SELECT coalesce(a.s1, b.s1) AS s1, coalesce(a.m, b.m) AS m, CAST(coalesce(a.r, 0) AS INTEGER) AS rank_a, CAST(coalesce(b.r, 0) AS INTEGER) AS rank_b FROM a FULL JOIN b ON a.s1 = b.s1 AND a.m = b.m"
)
def outer_rank_merge(spark: SparkSession, d: str) -> DataFrame:
    e = edges(spark, d)
    a = windows.top_k(e, ["s1"], "p", ["m"], 5, "r").select("s1", "m", "r", F.lit("a").alias("k"))
    w = Window.partitionBy("m").orderBy(F.desc("q"), F.desc("p"), "s1")
    b = e.withColumn("r", F.row_number().over(w)).filter("r <= 5").select("s1", "m", "r", F.lit("b").alias("k"))
    rank = lambda k: F.coalesce(F.min(F.when(F.col("k") == k, F.col("r"))), F.lit(0)).alias(f"rank_{k}")
    return a.unionByName(b).groupBy("s1", "m").agg(rank("a"), rank("b"))


@query(f"WITH {EDGES} SELECT s1, m, CAST(EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = s1 AND l_suppkey = m AND l_returnflag = 'R') AS INTEGER) AS label FROM edges")
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    hit = table(spark, d, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("m")).distinct().withColumn("label", F.lit(1))
    return edges(spark, d).select("s1", "m").join(hit, ["s1", "m"], "left").na.fill(0, ["label"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def semi_queries(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query(f"{REC} SELECT entity_id FROM rec WHERE src <> 'S1' AND entity_id NOT IN (SELECT m FROM truth)")
def anti_distractors(spark: SparkSession, d: str) -> DataFrame:
    rec = adapter.records(spark, d).filter("src <> 'S1'")
    return rec.join(adapter.true_pairs(spark, d), rec["entity_id"] == F.col("m"), "left_anti").select("entity_id")


@query("SELECT c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey WHERE s_nationkey NOT IN (SELECT s_nationkey FROM supplier GROUP BY 1 HAVING count(*) > 6)")
def block_join(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    over = s.groupBy("s_nationkey").agg(F.count("*").alias("n")).filter("n > 6").select("s_nationkey")
    s = s.join(small(over), "s_nationkey", "left_anti")
    return table(spark, d, "customer").join(s, F.col("c_nationkey") == F.col("s_nationkey")).select("c_custkey", "s_suppkey")


# aggregates


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1")
def cluster_sizes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_name LIMIT 15")
def value_counts_top(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "p_name").limit(15)


@query("SELECT lang, source, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY lang), 6) AS share FROM documents GROUP BY 1, 2")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))
    return n.select("lang", "source", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 6).alias("share"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean, round(stddev_samp(c_acctbal), 4) AS std, min(c_acctbal) AS min, round(quantile_cont(c_acctbal, .1), 4) AS p10, round(quantile_cont(c_acctbal, .25), 4) AS p25, round(quantile_cont(c_acctbal, .5), 4) AS p50, round(quantile_cont(c_acctbal, .75), 4) AS p75, max(c_acctbal) AS max FROM customer GROUP BY 1")
def percentile_profile(spark: SparkSession, d: str) -> DataFrame:
    c = "c_acctbal"
    q = [F.round(F.percentile(c, F.lit(p)), 4).alias(f"p{int(p * 100)}") for p in (0.1, 0.25, 0.5, 0.75)]
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(c), 4).alias("mean"), F.round(F.stddev_samp(c), 4).alias("std"), F.min(c).alias("min"), *q, F.max(c).alias("max"))


@query("SELECT CAST(least(n, 7) AS BIGINT) AS size, count(*) AS n_customers, round(100.0 * avg(CASE WHEN total > 200000 THEN 1.0 ELSE 0.0 END), 4) AS large_pct FROM (SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY 1) GROUP BY 1")
def capped_group_rate(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    return o.groupBy(F.least("n", F.lit(7).cast("bigint")).alias("size")).agg(F.count("*").alias("n_customers"), F.round(100.0 * F.avg((F.col("total") > 200000).cast("double")), 4).alias("large_pct"))


@query("SELECT token, count(*) AS c, round(ln((count(*) + 1.0) / 1.0), 6) AS weight FROM (SELECT unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> ''))) AS token FROM part) GROUP BY 1")
def token_df(spark: SparkSession, d: str) -> DataFrame:
    t = token_idf(table(spark, d, "part").select(F.col("p_name").alias("text")))
    return t.select("token", "c", F.round(F.log(F.col("c") + 1), 6).alias("weight"))


@query("WITH w AS (SELECT unnest(list_distinct(list_filter(string_split(p_name, ' '), lambda x: x <> ''))) AS token, (SELECT count(*) FROM part) AS n FROM part) SELECT token, count(*) AS c, round(ln((any_value(n) + 1) / (count(*) + 1)) + 1, 6) AS idf FROM w GROUP BY 1")
def token_idf_weights(spark: SparkSession, d: str) -> DataFrame:
    t = token_idf(table(spark, d, "part").select(F.col("p_name").alias("text")))
    return t.withColumn("idf", F.round("idf", 6))


@query("WITH c AS (SELECT l_partkey AS key, l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT key, value, n, CAST(total AS BIGINT) AS total FROM (SELECT *, sum(n) OVER (PARTITION BY key) AS total, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS r FROM c) WHERE r = 1 AND n >= 5 AND n >= total * 0.6")
def majority_vote(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("value")).agg(F.count("*").alias("n"))
    return majority(c, "key", "value", "n", 5, 0.6)


@query("SELECT source, count(*) FILTER (WHERE lang = 'de') AS de, count(*) FILTER (WHERE lang = 'en') AS en, count(*) FILTER (WHERE lang = 'es') AS es, count(*) FILTER (WHERE lang = 'fr') AS fr FROM documents GROUP BY 1")
def pivot_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy("source").pivot("lang", ["de", "en", "es", "fr"]).count().na.fill(0)


@query("SELECT p_brand, count(DISTINCT p_name) AS n_names FROM part GROUP BY 1")
def distinct_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy("p_brand").agg(F.countDistinct("p_name").alias("n_names"))


@query("SELECT max(greatest(l_quantity, l_linenumber * 10.0)) AS top, count(*) AS n FROM lineitem")
def max_over_columns(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").agg(F.max(F.greatest("l_quantity", F.col("l_linenumber") * 10.0)).alias("top"), F.count("*").alias("n"))


@query("SELECT o_custkey AS s1, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS kinds FROM orders GROUP BY 1")
def group_sets(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s1")).agg(F.array_sort(F.collect_set("o_orderpriority")).alias("k"))
    return o.select("s1", F.array_join("k", ",").alias("kinds"))


# windows


def windowed(name: str, sql: str, column) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return edges(spark, d).withColumn(name, column()).select("s1", "m", name)

    query(f"WITH {EDGES} SELECT s1, m, {sql} AS {name} FROM edges", name)(run)


windowed("rank_in_group", "CAST(rank() OVER (PARTITION BY s1 ORDER BY q DESC) AS INTEGER)", lambda: windows.rank_in_group("q", "s1"))
windowed("gap_to_best", "round(max(p) OVER (PARTITION BY s1) - p, 4)", lambda: F.round(windows.gap_to_best("p", "s1"), 4))
SECOND = "coalesce(nth_value(q, 2) OVER (PARTITION BY m ORDER BY q DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), -1.0)"
windowed("second_best", SECOND, lambda: windows.second_best("q", "m"))
windowed("margin", f"CASE WHEN q >= max(q) OVER (PARTITION BY m) THEN q - {SECOND} ELSE q - max(q) OVER (PARTITION BY m) END", lambda: windows.margin("q", "m"))
windowed("group_size", "count(*) OVER (PARTITION BY m)", lambda: windows.group_size("m"))
windowed("purity_share", "q / sum(q) OVER (PARTITION BY s1)", lambda: F.col("q") / F.sum("q").over(Window.partitionBy("s1")))


@query(f"WITH {EDGES} SELECT m, s1, p FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY p DESC, s1) AS r FROM edges) WHERE r = 1")
def best_owner(spark: SparkSession, d: str) -> DataFrame:
    return windows.best_owner(edges(spark, d)).select("m", "s1", "p")


@query(
    f"WITH {EDGES} SELECT s1, m, CAST(rank() OVER (PARTITION BY s1 ORDER BY q DESC) AS FLOAT) AS ret_rank_in_s1, max(q) OVER (PARTITION BY s1) - q AS ret_gap_s1_best, CAST(rank() OVER (PARTITION BY m ORDER BY q DESC) AS FLOAT) AS ret_rank_in_m, "
    f"max(q) OVER (PARTITION BY m) - q AS ret_gap_m_best, CASE WHEN q >= max(q) OVER (PARTITION BY m) THEN q - {SECOND} ELSE q - max(q) OVER (PARTITION BY m) END AS ret_margin_m, CAST(count(*) OVER (PARTITION BY m) AS SMALLINT) AS ret_n_s1_for_m FROM edges"
)
def context_features(spark: SparkSession, d: str) -> DataFrame:
    return windows.context_features(edges(spark, d).select("s1", "m", "q"), "q", "ret").drop("q")


# sorting and sampling


@query(f"WITH {EDGES} SELECT s1, m, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, m) AS r FROM edges) WHERE r <= 3")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    return windows.top_k(edges(spark, d), ["s1"], "p", ["m"], 3).select("s1", "m", "rank")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def top_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey DESC LIMIT 12")
def bottom_n(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy("o_totalprice", F.desc("o_orderkey")).limit(12)


def md5_sql(x: str, seed: str) -> str:
    return f"('0x' || substr(md5({x} || '{seed}'), 1, 8))::BIGINT"


@query(f"SELECT c_custkey FROM customer ORDER BY {md5_sql('c_custkey', '0')}, c_custkey LIMIT 40")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(table(spark, d, "customer").select("c_custkey"), "c_custkey", 40)


@query(f"SELECT c_custkey, CASE WHEN {md5_sql('c_custkey', '42')} < 429496729 THEN 'val' ELSE 'train' END AS fold FROM customer")
def hash_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.split(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(f"SELECT c_custkey, CAST({md5_sql('c_custkey', 'half0')} % 2 AS INTEGER) AS half FROM customer")
def half_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.halves(table(spark, d, "customer").select("c_custkey"), "c_custkey")


@query(
    "WITH r AS (SELECT c_mktsegment AS seg, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY substr(md5(CAST(c_custkey AS VARCHAR)), 1, 2), c_custkey) - 1 AS i, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer), "
    f"d AS (SELECT DISTINCT seg, n, unnest(range(0, 25)) AS draw FROM r) SELECT d.seg, CAST(draw AS INTEGER) AS draw, c_custkey FROM d JOIN r ON r.seg = d.seg AND r.i = {md5_sql(chr(40) + 'd.seg || ' + chr(39) + ':' + chr(39) + ' || draw' + chr(41), '0')} % d.n"
)
def replacement_sample(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").select(F.col("c_mktsegment").alias("seg"), "c_custkey")
    return sampling.with_replacement(c, "seg", "c_custkey", 25)


# sets


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region UNION ALL SELECT n_name, 'nation' FROM nation")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_name").alias("name"), F.lit("nation").alias("kind"))
    r = table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit("region").alias("kind"))
    return n.unionByName(r).unionByName(n)


def flagged(spark: SparkSession, d: str, flag: str) -> DataFrame:
    return table(spark, d, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("s1"), F.col("l_suppkey").alias("m"))


FLAGGED = "SELECT l_partkey AS s1, l_suppkey AS m FROM lineitem WHERE l_returnflag = '{}'"


@query(f"{FLAGGED.format('R')} UNION {FLAGGED.format('A')}")
def pair_union(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d, "R").unionByName(flagged(spark, d, "A")).distinct()


@query(f"{FLAGGED.format('R')} INTERSECT {FLAGGED.format('A')}")
def pair_intersect(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d, "R").intersect(flagged(spark, d, "A"))


@query(f"{FLAGGED.format('R')} EXCEPT {FLAGGED.format('A')}")
def pair_difference(spark: SparkSession, d: str) -> DataFrame:
    return flagged(spark, d, "R").subtract(flagged(spark, d, "A"))


@query("WITH x AS (SELECT o_custkey AS s1, o_orderpriority AS v, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) SELECT s1, string_agg(v, ',' ORDER BY f) AS kinds FROM x GROUP BY 1")
def ordered_dedup(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("s1")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("l"))
    return o.select("s1", F.array_join(F.array_distinct(F.transform("l", lambda x: x["o_orderpriority"])), ",").alias("kinds"))
