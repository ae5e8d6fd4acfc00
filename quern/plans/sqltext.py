"""Record normalisation in DuckDB SQL, for texts in Latin script and Devanagari, as CTEs that oracles start with."""

from __future__ import annotations

from quern.functions import tables as T
from quern.functions.text import romanize_text
from quern.sources.adapter import SQL as RECORDS


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_map(table: dict[str, str]) -> str:
    return "map{" + ", ".join(f"{literal(k)}: {literal(v)}" for k, v in table.items()) + "}"


def sql_list(values) -> str:
    return "[" + ", ".join(map(literal, values)) + "]"


def null_test(x: str) -> str:
    return f"(trim(coalesce({x}, '')) = '' OR list_contains({sql_list(T.NULL_TOKENS)}, lower(trim({x}))))"


def native(x: str) -> str:
    return f"regexp_matches({x}, '{T.INDIC}')"


def folded(x: str) -> str:
    """Accents off, lower case, for Latin text; native script stays."""
    return f"CASE WHEN {native(x)} THEN lower({x}) ELSE lower(strip_accents(replace(replace({x}, 'ß', 'ss'), 'æ', 'ae'))) END"


def romanized(x: str) -> str:
    """Devanagari letter by letter, other letters as ``folded`` has them."""
    table = {chr(i): romanize_text(chr(i)) for i in range(0x900, 0x980)}
    letters = f"array_to_string(list_transform(string_split(lower({x}), ''), lambda ch: coalesce({sql_map(table)}[ch], ch)), '')"
    return f"CASE WHEN {native(x)} THEN {letters} ELSE {folded(x)} END"


def cleaned(x: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '[°º]', ' ', 'g'), '[&+]', ' and ', 'g'), "
        f"'{T.NON_WORD}', ' ', 'g'), '[_\\s]+', ' ', 'g'))"
    )


def words(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda t: t <> '')"


def repaired(t: str) -> str:
    digits, letters = f"length(regexp_replace({t}, '[^0-9]', '', 'g'))", f"length(regexp_replace({t}, '[^\\p{{L}}]', '', 'g'))"
    return f"CASE WHEN {digits} > 0 AND {letters} >= 3 AND {letters} >= 2 * {digits} THEN translate({t}, '{T.OCR_FROM}', '{T.OCR_TO}') ELSE {t} END"


def skeleton(x: str) -> str:
    t = f"lower({x})"
    for c in "abcdefghijklmnopqrstuvwxyz":
        t = f"regexp_replace({t}, '{c}{c}+', '{c}', 'g')"
    for a, b in T.PHONETIC:
        t = f"replace({t}, '{a}', '{b}')"
    return t


def names(source: str, raw: str, keep: str = "*") -> str:
    """CTEs n1 to n6; n6 has the name columns."""
    return f"""n1 AS (SELECT {keep}, {null_test(raw)} AS _null, {folded(f"coalesce({raw}, '')")} AS _s0 FROM {source}),
n2 AS (SELECT *, CASE WHEN _null THEN '' ELSE replace(regexp_extract(_s0, {literal(T.DOMAIN)}, 1), '-', '') END AS _dom,
       replace(regexp_replace(_s0, {literal(T.DOMAIN)}, ' ', 'g'), '|', ' ') AS _s1 FROM n1),
n3 AS (SELECT *, list_filter(string_split_regex(_s1, {literal(T.ALIAS)}), lambda x: regexp_matches(x, '\\S')) AS _p FROM n2),
n4 AS (SELECT *, CASE WHEN _null OR len(_p) < 2 THEN '' ELSE {cleaned("_p[1]")} END AS name_alias,
       CASE WHEN len(_p) < 2 THEN _s1 WHEN {cleaned("_p[2]")} = '' THEN _p[1] ELSE _p[2] END AS _s2 FROM n3),
n4b AS (SELECT * EXCLUDE (_s2), NOT _null AND {native("_s2")} AS name_is_translit,
       CASE WHEN NOT _null AND {native("_s2")} THEN {romanized("array_to_string(list_filter(string_split_regex(_s2, '\\s+'), lambda w: w <> ''), ' ')")} ELSE _s2 END AS _s2 FROM n4),
n5a AS (SELECT *, list_transform({words(cleaned("_s2"))}, lambda t: {repaired("t")}) AS _t0 FROM n4b),
n5b AS (SELECT *, CASE WHEN NOT _null AND _dom = '' AND len(_t0) = 1 THEN regexp_extract(_t0[1], '{T.SQUASHED_COM}', 1) ELSE '' END AS _q FROM n5a),
n5 AS (SELECT *, CASE WHEN _q <> '' THEN _q ELSE _dom END AS name_domain,
       CASE WHEN _null THEN [] WHEN _q <> '' THEN [_q] WHEN len(_t0) = 0 AND _dom <> '' THEN [_dom] ELSE _t0 END AS _t FROM n5b),
n6 AS (SELECT * EXCLUDE (_null, _s0, _dom, _s1, _p, _s2, _t0, _q, _t), array_to_string(_t, ' ') AS name_norm,
       array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(_t, lambda t: NOT list_contains({sql_list(T.NAME_STOP)}, t)), lambda t: {sql_map(T.LEGAL)}[t]), lambda t: t IS NOT NULL))), ' ') AS name_legal,
       array_to_string(list_filter(_t, lambda t: NOT list_contains({sql_list([*T.NAME_STOP, *T.LEGAL])}, t)), ' ') AS name_core FROM n5)"""


def addresses(source: str, raw: str) -> str:
    """CTEs a1 to a6; a6 has the address columns."""
    token = "CASE WHEN regexp_matches(t, '^[0-9]+$') THEN (CASE WHEN ltrim(t, '0') = '' THEN '0' ELSE ltrim(t, '0') END) ELSE t END"
    mapped = f"list_transform(list_transform(list_transform(_w, lambda t: {token}), lambda t: coalesce({sql_map(T.STREET_TYPES)}[t], t)), lambda t: coalesce({sql_map(T.CITY_ALIASES)}[t], t))"
    return f"""a1 AS (SELECT *, CASE WHEN {null_test(raw)} THEN [] ELSE list_filter(list_transform(string_split(coalesce({raw}, ''), ','), lambda c: regexp_replace(c, '^\\s+|\\s+$', '', 'g')), lambda c: NOT {null_test("c")}) END AS _c FROM {source}),
a2 AS (SELECT *, len(_c) AS addr_ncomp, list_transform(_c, lambda c: rtrim(trim({romanized("c")}), '.')) AS _k FROM a1),
a3 AS (SELECT *, list_transform(_k, lambda k: {{'k': k, 's': coalesce({sql_map(T.STATES)}[k], CASE WHEN len(_c) > 1 AND length(k) = 2 AND list_contains({sql_list(T.STATE_CODES)}, k) THEN k END)}}) AS _z FROM a2),
a4 AS (SELECT *, coalesce(list_filter(_z, lambda z: z.s IS NOT NULL)[1].s, '') AS addr_state,
       {words(cleaned("array_to_string(list_transform(list_filter(_z, lambda z: z.s IS NULL), lambda z: z.k), ' ')"))} AS _w FROM a3),
a5 AS (SELECT *, list_filter(list_transform({mapped}, lambda t: CASE WHEN t LIKE '%cdp' AND length(t) > 3 THEN left(t, length(t) - 3) ELSE t END), lambda t: NOT list_contains({sql_list(T.ADDRESS_DROP)}, t)) AS _t FROM a4),
a5b AS (SELECT *, array_to_string(CASE WHEN addr_state <> '' AND len(_t) > 0 AND _t[-1] = addr_state THEN _t[:-2] ELSE _t END, ' ') AS addr_norm FROM a5),
a6 AS (SELECT * EXCLUDE (_c, _k, _z, _w, _t), len(list_filter(_c, lambda c: {native("c")})) > 0 AS addr_has_native,
       array_to_string(list_transform(regexp_extract_all(addr_norm, '\\d+(?:[a-z]+)?'), lambda x: CASE WHEN length(regexp_replace(x, '[0-9]', '', 'g')) > 1 THEN regexp_extract(x, '^\\d+') ELSE x END), ' ') AS addr_numbers,
       coalesce(regexp_extract_all(addr_norm, '\\b\\d{{5,6}}\\b')[-1], '') AS addr_postcode, regexp_extract(addr_norm, '\\d+') AS addr_house FROM a5b)"""


#: CTEs up to norm: the records of the test data with all derived columns.
NORM = f"""{RECORDS},
{names("rec", "business_name")},
{addresses("n6", "business_address")},
norm AS (SELECT * FROM a6)"""


def trigrams(x: str) -> str:
    """List of char trigrams of white-space words padded by one space."""
    return (
        f"flatten(list_transform(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> ''), "
        f"lambda w: list_transform(range(1, greatest(length(w), 1) + 1), lambda i: substr(' ' || w || ' ', i, 3))))"
    )


def lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two strings of which the first has at most 62 characters."""
    every = f"((1::BIGINT << length({a})) - 1)"
    mask = f"list_sum(list_transform(range(0, length({a})), lambda i: CASE WHEN substr({a}, (i + 1)::INT, 1) = ch THEN (1::BIGINT << i::INT) ELSE 0 END))::BIGINT"
    step = f"(((s + (s & h)) | (s - (s & h))) & {every})"
    hits = f"list_transform(string_split({b}, ''), lambda ch: coalesce({mask}, 0))"
    return f"(length({a}) - bit_count(list_reduce({hits}, lambda s, h: {step}, {every})))"


def ratio(a: str, b: str) -> str:
    s, t = f"(CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END)", f"(CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END)"
    return f"CASE WHEN {a} = '' AND {b} = '' THEN 100.0 WHEN {a} = '' OR {b} = '' THEN 0.0 ELSE 200.0 * {lcs(s, t)} / (length({a}) + length({b})) END"


def partial(s: str, t: str) -> str:
    """Best ratio of ``s`` with any window of the longer ``t``, cut off at both ends included; of equal lengths either way round."""

    def side(p: str, q: str) -> str:
        window = f"substr({q}, greatest(0, w0)::INT + 1, (least(length({q}), w0 + length({p})) - greatest(0, w0))::INT)"
        score = f"200.0 * {lcs(p, window)} / (length({p}) + length({window}))"
        return f"list_max(list_transform(range(1 - length({p}), length({q})), lambda w0: {score}))"

    return f"CASE WHEN {s} = '' OR {t} = '' THEN CASE WHEN {s} = {t} THEN 100.0 ELSE 0.0 END WHEN length({s}) = length({t}) THEN greatest({side(s, t)}, {side(t, s)}) ELSE {side(s, t)} END"
