"""String similarities on 0 to 100 (Jaro-Winkler 0 to 1), as Column expressions where the JVM can do it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.functions.text import tokens

#: Longest shorter side whose common-subsequence state fits a bigint.
LONGEST = 62


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit per character of a."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    every = (1 << len(a)) - 1
    state = every
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & every
    return len(a) - state.bit_count()


def ratio_text(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 200.0 * lcs_length(a, b) / total if total else 100.0


def token_set_text(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, da, db = (" ".join(sorted(z)) for z in (x & y, x - y, y - x))
    if both and (not da or not db):
        return 100.0
    with_a, with_b = f"{both} {da}".strip(), f"{both} {db}".strip()
    best = ratio_text(with_a, with_b)
    return max(best, ratio_text(both, with_a), ratio_text(both, with_b)) if both else best


def token_sort_text(a: str, b: str) -> float:
    return ratio_text(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def _pairs(f) -> object:
    """An Arrow UDF of two string columns; null where either is null."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict[tuple[str, str], float] = {}
        out = []
        for p in zip(a, b, strict=True):
            if p[0] is None or p[1] is None:
                out.append(None)
                continue
            if p not in known:
                known[p] = f(*p)
            out.append(known[p])
        return pd.Series(out, dtype="float64")

    run.__annotations__ = {"a": pd.Series, "b": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, DoubleType())


_long_ratio, _long_token_set, _long_token_sort = _pairs(ratio_text), _pairs(token_set_text), _pairs(token_sort_text)


def let(f, **values: Column) -> Column:
    """``f`` of a struct of the values: each is computed once, however often ``f`` names it."""
    return F.get(F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f), F.lit(0))


def _lcs(short: Column, long: Column) -> Column:
    """Bit-parallel common subsequence in a bigint; the shorter side has at most 62 characters."""
    zero = F.lit(0).cast("bigint")

    def bits(chars: Column, c: Column) -> Column:
        return F.aggregate(F.reverse(chars), zero, lambda acc, x: acc * 2 + F.when(x == c, F.expr("1L")).otherwise(zero))

    def count(v: Column) -> Column:
        def step(state: Column, ch: Column) -> Column:
            return let(lambda r: (r["s"] + r["h"]).bitwiseOR(r["s"] - r["h"]).bitwiseAND(v["every"]), s=state, h=state.bitwiseAND(F.coalesce(F.try_element_at(v["where"], ch), zero)))

        return (v["n"] - F.bit_count(F.aggregate(F.filter(F.split(long, ""), lambda x: x != ""), v["every"], step))).cast("double")

    def masks(v: Column) -> Column:
        distinct = F.array_distinct(v["chars"])
        every = F.call_function("shiftleft", F.expr("1L"), F.size(v["chars"])) - 1
        return let(count, where=F.map_from_arrays(distinct, F.transform(distinct, lambda c: bits(v["chars"], c))), every=every, n=F.size(v["chars"]))

    return let(masks, chars=F.filter(F.split(short, ""), lambda x: x != ""))


def _ratio(a: Column, b: Column) -> Column:
    """Indel ratio of two strings, null if the shorter one has more than 62 characters."""

    def sized(v: Column) -> Column:
        total = F.length(v["s"]) + F.length(v["t"])
        value = F.lit(200.0) * _lcs(v["s"], v["t"]) / F.greatest(total, F.lit(1))
        return F.when(total == 0, F.lit(100.0)).when(F.length(v["s"]) <= LONGEST, value)

    def ordered(v: Column) -> Column:
        first = F.length(v["a"]) <= F.length(v["b"])
        return let(sized, s=F.when(first, v["a"]).otherwise(v["b"]), t=F.when(first, v["b"]).otherwise(v["a"]))

    return let(ordered, a=a, b=b)


def _with_long(a: Column, b: Column, value: Column, udf, long: bool) -> Column:
    fits = F.least(F.length(a), F.length(b)) <= LONGEST
    out = F.when(fits, value)
    return out.otherwise(udf(F.when(~fits, a), F.when(~fits, b))) if long else out


def ratio(a: Column, b: Column, long: bool = False) -> Column:
    """Indel ratio 200 * LCS / (len a + len b), 100 for two empty strings.

    ``long`` adds an Arrow UDF for pairs whose shorter side exceeds 62 characters (such pairs are null without it).
    """
    return _with_long(a, b, _ratio(a, b), _long_ratio, long)


def token_sort_ratio(a: Column, b: Column, long: bool = False) -> Column:
    return _with_long(a, b, _ratio(*(F.array_join(F.array_sort(tokens(x)), " ") for x in (a, b))), _long_token_sort, long)


def token_set_ratio(a: Column, b: Column, long: bool = False) -> Column:
    """Best ratio among the common tokens and the common tokens with each side's rest."""
    join = lambda c: F.array_join(F.array_sort(c), " ")

    def best(v: Column) -> Column:
        full = _ratio(v["wa"], v["wb"])
        # the common tokens are a prefix of the other string, so that ratio needs no common subsequence
        part = lambda w: F.lit(200.0) * F.length(v["both"]) / F.greatest(F.length(v["both"]) + F.length(w), F.lit(1))
        return F.when(v["both"] == "", full).otherwise(F.greatest(full, part(v["wa"]), part(v["wb"])))

    def joined(v: Column) -> Column:
        with_a, with_b = (F.when(v["both"] == "", v[d]).otherwise(F.concat(v["both"], F.lit(" "), v[d])) for d in ("da", "db"))
        done = (v["both"] != "") & ((v["da"] == "") | (v["db"] == ""))
        return F.when(done, F.lit(100.0)).otherwise(let(best, both=v["both"], wa=with_a, wb=with_b))

    def split(v: Column) -> Column:
        none = (F.size(v["x"]) == 0) | (F.size(v["y"]) == 0)
        parts = {"both": F.array_intersect(v["x"], v["y"]), "da": F.array_except(v["x"], v["y"]), "db": F.array_except(v["y"], v["x"])}
        return F.when(none, F.lit(0.0)).otherwise(let(joined, **{k: join(c) for k, c in parts.items()}))

    value = let(split, x=F.array_distinct(tokens(a)), y=F.array_distinct(tokens(b)))
    return _with_long(a, b, value, _long_token_set, long)


def partial_text(a: str, b: str) -> float:
    """Best ratio of the shorter string with any window of the longer one, windows cut off at both ends included."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    m, best = len(s), 0.0
    sides = [(s, t), (t, s)] if len(s) == len(t) else [(s, t)]
    for p, q in sides:
        letters = set(p)
        for i in range(1 - m, len(q)):
            window = q[max(0, i) : i + m]
            if window[-1 if i <= 0 else 0] not in letters and window[0 if i > 0 else -1] not in letters:
                continue
            best = max(best, ratio_text(p, window))
            if best == 100.0:
                return best
    return best


def jaro_winkler_text(a: str, b: str, weight: float = 0.1, boost_from: float = 0.7) -> float:
    if not a and not b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, first = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                first.append(ch)
                break
    m = len(first)
    if not m:
        return 0.0
    second = [ch for ch, u in zip(b, used, strict=True) if u]
    swaps = sum(x != y for x, y in zip(first, second, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4], strict=False):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * weight * (1 - jaro) if jaro > boost_from else jaro


partial_ratio = _pairs(partial_text)
jaro_winkler = _pairs(jaro_winkler_text)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard of distinct tokens, 0 if either side has none."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def number_jaccard(a: Column, b: Column) -> Column:
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(-1.0)).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def house_match(a: Column, b: Column) -> Column:
    """2 equal, 1 one begins or ends with the other, 0 different, -1 missing."""
    near = a.startswith(b) | a.endswith(b) | b.startswith(a) | b.endswith(a)
    return F.when((a == "") | (b == ""), F.lit(-1)).when(a == b, F.lit(2)).when(near, F.lit(1)).otherwise(F.lit(0))


def field_eq(a: Column, b: Column) -> Column:
    return F.when((a == "") | (b == ""), F.lit(-1)).when(a == b, F.lit(1)).otherwise(F.lit(0))


def idf_overlap(a: Column, b: Column, idf: Column, default: Column) -> tuple[Column, Column]:
    """IDF-weighted share of a's tokens found in b, and weighted Jaccard; 0 if either side has no tokens.

    ``idf`` is a map column of the tokens of both sides; a token it lacks weighs ``default``.
    """
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))

    def weight(c: Column) -> Column:
        return F.aggregate(F.array_sort(c), F.lit(0.0), lambda acc, t: acc + F.coalesce(F.try_element_at(idf, t), default))

    common = weight(F.array_intersect(x, y))
    none = (F.size(x) == 0) | (F.size(y) == 0)
    return tuple(F.when(none, F.lit(0.0)).otherwise(F.try_divide(common, weight(c))) for c in (x, F.array_union(x, y)))
