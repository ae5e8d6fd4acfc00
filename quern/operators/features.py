"""Pairwise features of candidate pairs (s1, m)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType, StructField, StructType

from quern.functions import pairwise
from quern.functions import similarity as S
from quern.functions.text import nth_token, tokens
from quern.operators.retrieval import RANKS
from quern.operators.windows import context_features
from quern.runtime import partitions, stage

NO_RANK = 99
FIELDS = ("name_norm", "name_core", "name_legal", "name_alias", "name_domain", "name_is_translit", "addr_norm", "addr_state", "addr_house", "addr_numbers", "addr_postcode")
#: What is added to the fields of a record.
ADDED = ("idf_map", "name_idf", "addr_idf", "name_first")


def token_idf(texts: DataFrame, text: str = "text") -> DataFrame:
    """(token, c, idf): ln((n + 1) / (c + 1)) + 1 over the distinct tokens of each text."""
    n = texts.agg(F.count("*").alias("n"))
    c = texts.select(F.explode(F.array_distinct(tokens(F.col(text)))).alias("token")).groupBy("token").agg(F.count("*").alias("c"))
    return c.join(F.broadcast(n)).select("token", "c", (F.log((F.col("n") + 1) / (F.col("c") + 1)) + 1).alias("idf"))


def idf_texts(records: DataFrame) -> DataFrame:
    """Names and addresses of all sources as separate texts."""
    return records.select(F.explode(F.array("name_core", "addr_norm")).alias("text"))


def with_idf_map(records: DataFrame, idf: DataFrame) -> DataFrame:
    """Add ``idf_map``, the weights of a record's own tokens, by one join on the token: the vocabulary isn't broadcast."""
    own = records.select("entity_id", F.explode(F.array_distinct(tokens(F.concat_ws(" ", "name_core", "addr_norm")))).alias("token"))
    maps = own.join(idf.select("token", "idf"), "token").groupBy("entity_id").agg(F.map_from_entries(F.collect_list(F.struct("token", "idf"))).alias("idf_map"))
    return records.join(maps, "entity_id", "left")


def fields(records: DataFrame, ident: str, prefix: str) -> DataFrame:
    return records.select(F.col("entity_id").alias(ident), *[F.col(c).alias(f"{prefix}{c}") for c in records.columns if c in (*FIELDS, *ADDED)])


def paired(cand: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates with the fields of both records, l_ and r_; a missing record is an inner join's loss."""
    return cand.join(fields(records, "m", "r_"), "m").join(fields(records, "s1", "l_"), "s1")


def hashed(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """``df`` to be hashed in a join if a partition has at most ``rows`` of its rows, so that the wide other side isn't sorted."""
    return df.hint("shuffle_hash") if df.count() <= rows * partitions(df.sparkSession) else df


def n_tokens(c: Column) -> Column:
    """Spaces plus one."""
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit(""))) + 1


def simple_features() -> dict[str, Column]:
    """What needs neither ranks, cosines nor weights nor Python."""
    c = F.col
    i = lambda x: x.cast("int")
    return {
        "src_s3": i(c("m").startswith("S3")),
        "nm_exact": i(c("l_name_core") == c("r_name_core")),
        "nm_first_eq": i((nth_token(c("l_name_core"), 0) == nth_token(c("r_name_core"), 0)) & (c("l_name_core") != "")),
        "nm_ntok_l": n_tokens(c("l_name_core")),
        "nm_ntok_diff": n_tokens(c("r_name_core")) - n_tokens(c("l_name_core")),
        "legal_eq": S.field_eq(c("l_name_legal"), c("r_name_legal")),
        "r_translit": i(c("r_name_is_translit")),
        "r_name_empty": i(c("r_name_core") == ""),
        "r_addr_empty": i(c("r_addr_norm") == ""),
        "ad_ntok_ratio": n_tokens(c("r_addr_norm")) / n_tokens(c("l_addr_norm")),
        "num_jacc": S.number_jaccard(c("l_addr_numbers"), c("r_addr_numbers")),
        "house": S.house_match(c("l_addr_house"), c("r_addr_house")),
        "state_eq": S.field_eq(c("l_addr_state"), c("r_addr_state")),
        "postcode_eq": S.field_eq(c("l_addr_postcode"), c("r_addr_postcode")),
    }


def string_features() -> dict[str, Column]:
    c = F.col
    no_addr = c("r_addr_norm") == ""
    return {
        "nm_ratio": S.ratio(c("l_name_core"), c("r_name_core"), True),
        "nm_tset": S.token_set_ratio(c("l_name_core"), c("r_name_core"), True),
        "nm_tsort": S.token_sort_ratio(c("l_name_core"), c("r_name_core"), True),
        "nm_partial": S.partial_ratio(c("l_name_core"), c("r_name_core")),
        "nm_jw": S.jaro_winkler(c("l_name_core"), c("r_name_core")),
        "nm_full_tset": S.token_set_ratio(c("l_name_norm"), c("r_name_norm"), True),
        "dom_ratio": F.when(c("r_name_domain") == "", F.lit(-1.0)).otherwise(S.partial_ratio(F.replace(c("l_name_norm"), F.lit(" "), F.lit("")), c("r_name_domain"))),
        "alias_ratio": F.when(c("r_name_alias") == "", F.lit(-1.0)).otherwise(S.token_set_ratio(c("l_name_core"), c("r_name_alias"), True)),
        "ad_tset": F.when(no_addr, F.lit(-1.0)).otherwise(S.token_set_ratio(c("l_addr_norm"), c("r_addr_norm"), True)),
        "ad_tsort": F.when(no_addr, F.lit(-1.0)).otherwise(S.token_sort_ratio(c("l_addr_norm"), c("r_addr_norm"), True)),
        "ad_partial": F.when(no_addr, F.lit(-1.0)).otherwise(S.partial_ratio(c("l_addr_norm"), c("r_addr_norm"))),
    }


def idf_features(default: Column) -> dict[str, Column]:
    c = F.col
    idf = F.map_zip_with(F.coalesce("l_idf_map", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), F.coalesce("r_idf_map", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))), lambda k, a, b: F.coalesce(a, b))
    left, jac = S.idf_overlap(c("l_name_core"), c("r_name_core"), idf, default)
    right, _ = S.idf_overlap(c("r_name_core"), c("l_name_core"), idf, default)
    address, _ = S.idf_overlap(c("r_addr_norm"), c("l_addr_norm"), idf, default)
    return {"nm_idf_cov_l": left, "nm_idf_jac": jac, "nm_idf_cov_r": right, "ad_idf_cov_r": address}


def retrieval_features(columns: list[str]) -> dict[str, Column]:
    """Ranks with 99 for none (and for retrievers that weren't run), how many retrievers found the pair, mean cosine."""
    ranks = {r: (F.when(F.col(r) == 0, F.lit(NO_RANK)).otherwise(F.col(r)) if r in columns else F.lit(NO_RANK)).cast("smallint") for r in RANKS}
    n = reduce(lambda a, b: a + b, [(ranks[r] < NO_RANK).cast("int") for r in RANKS])
    return {**ranks, "n_retrievers": n, "cos_mean": (F.col("cos_name") + F.col("cos_addr")) / 2}


#: The weighted overlaps of names and addresses, and the string features, as ``wide_features`` returns them.
OVERLAPS = ("nm_idf_cov_l", "nm_idf_jac", "nm_idf_cov_r", "ad_idf_cov_r")
STRINGS = ("nm_ratio", "nm_tset", "nm_tsort", "nm_partial", "nm_jw", "nm_full_tset", "dom_ratio", "alias_ratio", "ad_tset", "ad_tsort", "ad_partial")
TEXTS = ("l_name_norm", "r_name_norm", "l_name_core", "r_name_core", "r_name_alias", "r_name_domain", "l_addr_norm", "r_addr_norm")
WEIGHTS = ("l_name_idf", "r_name_idf", "l_addr_idf", "r_addr_idf")


def with_idf_lists(records: DataFrame, idf: DataFrame) -> DataFrame:
    """Add ``name_idf`` and ``addr_idf``: the weights of the distinct tokens of each text, in the order of the tokens."""
    most = F.broadcast(idf.agg(F.max("idf").alias("_default")))
    weights = lambda c: F.transform(F.array_sort(F.array_distinct(tokens(F.col(c)))), lambda t: F.coalesce(F.try_element_at("idf_map", t), F.col("_default")))
    rows = with_idf_map(records, idf).join(most)
    return rows.withColumns({"name_idf": weights("name_core"), "addr_idf": weights("addr_norm")}).drop("_default", "idf_map")


def wide_features(rows: pa.Table, strings: bool = True) -> dict[str, np.ndarray]:
    """``OVERLAPS`` and ``STRINGS`` of rows with ``TEXTS`` and ``WEIGHTS``; distinct pairs of texts are compared once."""
    names, addresses = (pairwise.Pairs(rows[f"l_{c}"], rows[f"r_{c}"]) for c in ("name_core", "addr_norm"))

    def weights(text: str, idf: str) -> dict[str, dict[str, float]]:
        column = rows[text].combine_chunks().dictionary_encode()
        known, first = np.unique(column.indices.fill_null(-1).to_numpy(zero_copy_only=False), return_index=True)
        first, some = first[known >= 0], rows[idf].combine_chunks().take
        lists = some(pa.array(first)).to_pylist()
        return {t: dict(zip(pairwise.words(t), w, strict=True)) for t, w in zip(rows[text].combine_chunks().take(pa.array(first)).to_pylist(), lists, strict=True)}

    left, right, jaccard = pairwise.overlaps(names, weights("l_name_core", "l_name_idf"), weights("r_name_core", "r_name_idf"), True)
    out = {"nm_idf_cov_l": left, "nm_idf_jac": jaccard, "nm_idf_cov_r": right}
    out["ad_idf_cov_r"] = pairwise.overlaps(addresses, weights("l_addr_norm", "l_addr_idf"), weights("r_addr_norm", "r_addr_idf"), False)[1]
    if not strings:
        return out

    def unless_empty(right: str, name: str, left: pa.ChunkedArray) -> np.ndarray:
        """-1 where the right text is empty."""
        some = pc.fill_null(pc.not_equal(rows[right], ""), True)
        value, at = np.full(rows.num_rows, -1.0), some.to_numpy(zero_copy_only=False)
        value[at] = pairwise.Pairs(left.filter(some), rows[right].filter(some))(name)
        return value

    out |= {"nm_ratio": names("ratio"), "nm_tset": names("token_set"), "nm_tsort": names("token_sort"), "nm_partial": names("partial"), "nm_jw": names("jaro_winkler")}
    out["nm_full_tset"] = pairwise.Pairs(rows["l_name_norm"], rows["r_name_norm"])("token_set")
    out["dom_ratio"] = unless_empty("r_name_domain", "partial", pc.replace_substring(rows["l_name_norm"], " ", ""))
    out["alias_ratio"] = unless_empty("r_name_alias", "token_set", rows["l_name_core"])
    for name, f in (("ad_tset", "token_set"), ("ad_tsort", "token_sort"), ("ad_partial", "partial")):
        out[name] = unless_empty("r_addr_norm", f, rows["l_addr_norm"])
    return out


def with_wide_features(pairs: DataFrame, strings: bool) -> DataFrame:
    """``pairs`` with ``wide_features`` as floats in place of ``TEXTS`` and ``WEIGHTS``, many rows at a time."""
    kept, names = [c for c in pairs.columns if c not in (*TEXTS, *WEIGHTS)], (*OVERLAPS, *(STRINGS if strings else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(some: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(some)
            found = wide_features(rows, strings)
            columns = [rows[c] for c in kept] + [pa.array(found[c], pa.float32(), from_pandas=True) for c in names]
            yield from pa.table(columns, names=[*kept, *names]).combine_chunks().to_batches(10_000)

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= pairwise.ROWS:
                yield from done(held)
                held, n = [], 0
        if n:
            yield from done(held)

    schema = StructType([*[pairs.schema[c] for c in kept], *[StructField(c, FloatType()) for c in names]])
    return pairs.mapInArrow(run, schema)


def pair_features(cand: DataFrame, records: DataFrame, strings: bool = True) -> DataFrame:
    """The candidates with the 38 pairwise features (27 without ``strings``) and the six of retrieval competition.

    The competition is ranked before the fields are joined, so its shuffles move narrow rows."""
    floats = lambda df, names: df.withColumns({c: F.col(c).cast("float") for c in names if dict(df.dtypes)[c] == "double"})
    of_retrieval, simple = retrieval_features(cand.columns), simple_features()
    simple["nm_first_eq"] = ((F.col("l_name_first") == F.col("r_name_first")) & (F.col("l_name_core") != "")).cast("int")
    keep = ["s1", "m", "cos_name", "cos_addr"]
    ranked = floats(cand.withColumns(of_retrieval).select(*keep, *of_retrieval), ["n_retrievers", "cos_mean"])
    ranked = context_features(ranked, "cos_mean", "ret")
    idf = stage(token_idf(idf_texts(records)))
    kept = [c for c in records.columns if c in (*FIELDS, "src")]
    rows = stage(with_idf_lists(records, idf).select("entity_id", *kept, nth_token(F.col("name_core"), 0).alias("name_first"), "name_idf", "addr_idf"))
    left = rows.filter("src = 'S1'") if "src" in kept else rows
    both = ranked.join(hashed(fields(rows, "m", "r_")), "m").join(hashed(fields(left, "s1", "l_")), "s1")
    wide = floats(both.withColumns(simple).select(*ranked.columns, *simple, *TEXTS, *WEIGHTS), simple)
    out = with_wide_features(wide, strings)
    return out.select(*keep, *of_retrieval, *simple, *OVERLAPS, *(STRINGS if strings else ()), *[c for c in ranked.columns if c.startswith("ret_")])


def labelled(features: DataFrame, truth: DataFrame) -> DataFrame:
    flags = truth.select("s1", "m", F.lit(1).alias("label")).distinct()
    return features.join(flags, ["s1", "m"], "left").withColumn("label", F.coalesce("label", F.lit(0)).cast("tinyint"))
