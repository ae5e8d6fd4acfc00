"""Scalar text functions and record normalisation as Column expressions.

Folding, NFKC and romanisation go letter by letter over tables made by rule from the Unicode database, for texts in
which no letter acts on its neighbours (Latin letters with accents, Indic letters but for the few that compose). Only
other texts need Python; ``prepared`` filters their rows off, so that the rest never meet a Python worker.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quern.functions import tables as T

ASCII = r"^[\x00-\x7F]*\z"
#: Scripts that ``script_of`` names, by the Unicode property that tells them.
SCRIPTS = (
    "Latin Devanagari Bengali Gurmukhi Gujarati Oriya Tamil Telugu Kannada Malayalam Sinhala Greek Cyrillic Arabic Hebrew Thai Armenian Georgian Hiragana Katakana Hangul Han"
).split()
#: Letters that decomposition doesn't turn into ASCII.
LETTERS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "þ": "th", "Þ": "Th", "ð": "d", "Ð": "D", "ı": "i", "ħ": "h", "Ħ": "H", "°": "deg"}
MARKS = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "€": "EUR", "₹": "Rs"}


def is_null(c: Column) -> Column:
    """Null, blank, or a spelling of a missing cell."""
    t = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    return (t == "") | t.isin(*T.NULL_TOKENS)


def script_of(c: Column) -> Column:
    """The script of the first letter, NONE without letters."""
    first = F.regexp_extract(c, r"\p{L}", 0)
    out = F.when(first == "", F.lit("NONE"))
    for s in SCRIPTS:
        out = out.when(first.rlike(rf"\p{{Is{s}}}"), F.lit("CJK" if s == "Han" else s.upper()))
    return out.otherwise(F.lit("UNKNOWN"))


@lru_cache(4096)
def _latin(ch: str) -> str:
    if ch in LETTERS:
        return LETTERS[ch]
    if ord(ch) < 128:
        return ch
    if ord(ch) <= 0x24F or 0x1E00 <= ord(ch) <= 0x1EFF:
        plain = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        return "".join(LETTERS.get(x, x) for x in plain if ord(x) < 128 or x in LETTERS)
    return ch


def fold_text(s: str) -> str:
    """NFKC, accents off Latin letters, lower case; other scripts stay."""
    return "".join(map(_latin, unicodedata.normalize("NFKC", s))).lower()


@lru_cache(4096)
def _roman(ch: str) -> str:
    """Latin letters for one character; Indic ones by their Unicode names (consonants without the inherent vowel)."""
    if 0x0900 <= ord(ch) <= 0x0DFF:
        name = unicodedata.name(ch, "")
        last = name.split()[-1] if name else ""
        if unicodedata.decimal(ch, None) is not None:
            return str(unicodedata.decimal(ch))
        if "VOWEL SIGN" in name:
            return last.lower()
        if name.endswith(("ANUSVARA", "CANDRABINDU", "BINDI", "TIPPI")):
            return "n"
        if name.endswith("VISARGA"):
            return "h"
        if "LETTER" in name:
            return last[:-1].lower() if len(last) > 1 and last.endswith("A") and last not in ("AA", "A") else last.lower()
        return ""
    return MARKS.get(ch, _latin(ch))


def romanize_text(s: str) -> str:
    return "".join(map(_roman, s)).lower()


def _ranges(codes: list[int]) -> str:
    """A character class of code points in order, as ranges."""
    out, i = [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        out.append(f"\\x{{{codes[i]:X}}}-\\x{{{codes[j]:X}}}")
        i = j + 1
    return "".join(out)


LATIN_CODES = [*range(0x80, 0x250), *range(0x1E00, 0x1F00), *sorted(map(ord, MARKS))]
INDIC_CODES = range(0x900, 0xE00)
#: Second parts of letters that compose.
_TAILS = {ord(c) for i in INDIC_CODES for c in unicodedata.normalize("NFD", chr(i))[1:]}
_ALONE = sorted({*LATIN_CODES, *(i for i in INDIC_CODES if unicodedata.normalize("NFKC", chr(i)) == chr(i) and unicodedata.combining(chr(i)) in (0, 9) and i not in _TAILS)})
#: Texts whose normal form is that of their letters one by one.
BY_LETTER = rf"^[\x00-\x7F{_ranges(_ALONE)}]*\z"


def _by_letter(c: Column, table: dict[str, str]) -> Column:
    """Each letter replaced by what the table has for it, ASCII letters by themselves."""
    changed = {k: v for k, v in table.items() if k != v}
    one = {k: v for k, v in changed.items() if len(v) == 1}
    none = [k for k, v in changed.items() if not v]
    more = {k: v for k, v in changed.items() if len(v) > 1}
    t = F.translate(c, "".join([*one, *none]), "".join(one.values()))
    if more:
        spelled = F.array_join(F.transform(F.split(t, ""), lambda x: F.coalesce(F.try_element_at(lookup(more), x), x)), "")
        t = F.when(t.rlike(f"[{_ranges(sorted(map(ord, more)))}]"), spelled).otherwise(t)
    return F.when(c.rlike(ASCII), c).otherwise(t)


FOLDED = {chr(i): fold_text(chr(i)) for i in _ALONE}
COMPATIBLE = {chr(i): unicodedata.normalize("NFKC", chr(i)) for i in _ALONE}
ROMAN = {chr(i): romanize_text(chr(i)) for i in [*LATIN_CODES, *INDIC_CODES]}


@F.pandas_udf(StringType())
def _fold(s: pd.Series) -> pd.Series:
    return s.map(fold_text, na_action="ignore")


@F.pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def romanize(c: Column) -> Column:
    return F.lower(_by_letter(c, ROMAN))


#: By kind of normal form: the table of letters, the way for other texts, and what both end with.
FORMS = {"fold": (FOLDED, _fold, F.lower), "nfkc": (COMPATIBLE, _nfkc, lambda c: c)}


def prepared(df: DataFrame, **forms: tuple[str, str]) -> DataFrame:
    """Add columns, each the normal form (kind, column) of a column with nulls as empty texts.

    Rows whose texts can be done letter by letter stay in the JVM; the others are filtered off, go through Python
    and are put back by a union.
    """
    filled = {name: F.coalesce(F.col(raw), F.lit("")) for name, (_, raw) in forms.items()}
    plain = reduce(lambda a, b: a & b, [c.rlike(BY_LETTER) for c in filled.values()])
    quick = df.filter(plain).withColumns({n: FORMS[kind][2](_by_letter(filled[n], FORMS[kind][0])) for n, (kind, _) in forms.items()})
    slow = df.filter(~plain).withColumns({n: FORMS[kind][1](filled[n]) for n, (kind, _) in forms.items()})
    return quick.unionByName(slow)


def fold(c: Column) -> Column:
    """``fold_text`` as one expression; all rows pass a Python worker, with nulls for those that don't need it."""
    return F.when(c.rlike(BY_LETTER), F.lower(_by_letter(c, FOLDED))).otherwise(_fold(F.when(~c.rlike(BY_LETTER), c)))


def squash_phonetic(c: Column) -> Column:
    """Consonant skeleton: repeated letters once, aspirates simplified in order, vowels off after the first letter."""
    t = F.regexp_replace(F.lower(c), r"([a-z])\1+", "$1")
    t = reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), T.PHONETIC, t)
    return F.concat(F.substring(t, 1, 1), F.regexp_replace(F.substr(t, F.lit(2)), "[aeiouy]", ""))


def fix_ocr_token(c: Column) -> Column:
    """Digits that stand for letters, in tokens with at least three letters and twice as many letters as digits."""
    digits = F.length(F.regexp_replace(c, r"[^\p{Nd}]", ""))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.when((digits > 0) & (letters >= 3) & (letters >= 2 * digits), F.translate(c, T.OCR_FROM, T.OCR_TO)).otherwise(c)


def clean_text(c: Column) -> Column:
    t = F.regexp_replace(c, "[°º]", " ")
    t = F.regexp_replace(t, "[&+]", " and ")
    t = F.regexp_replace(t, "(?U)" + T.NON_WORD, " ")
    return F.btrim(F.regexp_replace(t, r"(?U)[_\s]+", " "))


def tokens(c: Column) -> Column:
    """The words of a text by single spaces; none for an empty text."""
    return F.filter(F.split(c, " "), lambda x: x != "")


def spaced_tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda x: x != "")


def lookup(table: dict[str, str]) -> Column:
    """A constant map, made from one literal."""
    return F.str_to_map(F.lit("\t".join(f"{k}\n{v}" for k, v in table.items())), F.lit("\t"), F.lit("\n"))


def domain_stem(c: Column) -> Column:
    return F.replace(F.regexp_extract(c, T.DOMAIN, 1), F.lit("-"), F.lit(""))


def alias_parts(c: Column) -> Column:
    return F.filter(F.split(c, T.ALIAS, -1), lambda x: F.btrim(F.regexp_replace(x, r"\s", " ")) != "")


def char_trigrams(c: Column) -> Column:
    """Trigrams of each white-space word between one space on either side, repeats included."""
    padded = F.transform(spaced_tokens(c), lambda w: F.concat(F.lit(" "), w, F.lit(" ")))
    return F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - 2, F.lit(1))), lambda i: F.substr(w, i, F.lit(3)))))


def name_text(name_norm: Column, name_domain: Column) -> Column:
    """Retrieval text: the name, and the domain stem where the squashed name doesn't hold it."""
    adds = (name_domain != "") & ~F.contains(F.replace(name_norm, F.lit(" "), F.lit("")), name_domain)
    return F.btrim(F.when(adds, F.concat(name_norm, F.lit(" "), name_domain)).otherwise(name_norm))


def parse_id_list(c: Column) -> Column:
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def nth_token(c: Column, n: int) -> Column:
    return F.coalesce(F.get(spaced_tokens(c), F.lit(n)), F.lit(""))


def transliterate(tokens_: Column, native: Column | None) -> Column:
    """Tokens romanised, each replaced by what the learned dictionary has for its skeleton."""
    roman = spaced_tokens(romanize(F.array_join(tokens_, " ")))
    if native is None:
        return roman
    return F.transform(roman, lambda r: F.coalesce(F.try_element_at(native, squash_phonetic(r)), r))


def normalize_names(df: DataFrame, raw: str = "business_name", native_token: Column | None = None) -> DataFrame:
    """Add name_script, name_norm, name_core, name_legal, name_alias, name_domain, name_is_translit."""
    c = F.coalesce(F.col(raw), F.lit(""))
    if "_fold" not in df.columns:
        df = prepared(df, _fold=("fold", raw))
    df = df.withColumn("_null", is_null(F.col(raw))).withColumnRenamed("_fold", "_s")
    df = df.withColumn("name_script", F.when(F.col("_null"), F.lit("NONE")).otherwise(script_of(c)))
    s = F.col("_s")
    df = df.withColumn("name_domain", F.when(F.col("_null"), F.lit("")).otherwise(domain_stem(s)))
    df = df.withColumn("_s", F.replace(F.regexp_replace(s, T.DOMAIN, " "), F.lit("|"), F.lit(" ")))
    df = df.withColumn("_p", alias_parts(s))
    second = F.get("_p", F.lit(1))
    df = df.withColumns({
        "name_alias": F.when(F.col("_null") | (F.size("_p") < 2), F.lit("")).otherwise(clean_text(F.get("_p", F.lit(0)))),
        "_s": F.when(F.size("_p") < 2, s).when(clean_text(second) == "", F.get("_p", F.lit(0))).otherwise(second),
    })
    df = df.withColumn("name_is_translit", ~F.col("_null") & s.rlike(T.INDIC))
    df = df.withColumn("_s", F.when(F.col("name_is_translit"), F.array_join(transliterate(spaced_tokens(s), native_token), " ")).otherwise(s))
    df = df.withColumn("_t", F.transform(tokens(clean_text(s)), fix_ocr_token))
    squashed = F.when((F.col("name_domain") == "") & (F.size("_t") == 1), F.regexp_extract(F.get("_t", F.lit(0)), T.SQUASHED_COM, 1)).otherwise(F.lit(""))
    df = df.withColumn("_q", F.when(F.col("_null"), F.lit("")).otherwise(squashed))
    df = df.withColumn("name_domain", F.when(F.col("_q") != "", F.col("_q")).otherwise(F.col("name_domain")))
    df = df.withColumn(
        "_t",
        F.when(F.col("_null"), F.array().cast("array<string>")).when(F.col("_q") != "", F.array("_q"))
        .when((F.size("_t") == 0) & (F.col("name_domain") != ""), F.array("name_domain")).otherwise(F.col("_t")),
    )
    legal = lookup(T.LEGAL)
    kept = F.filter("_t", lambda x: ~x.isin(*T.NAME_STOP))
    return df.withColumns({
        "name_norm": F.array_join("_t", " "),
        "name_legal": F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(kept, lambda x: F.try_element_at(legal, x)), lambda x: x.isNotNull()))), " "),
        "name_core": F.array_join(F.filter(kept, lambda x: ~x.isin(*T.LEGAL)), " "),
    }).drop("_null", "_s", "_p", "_t", "_q")


def state_of(component: Column, several: Column) -> Column:
    """The code of a component that is a state's name, or, among several components, a bare code; else null."""
    bare = several & (F.length(component) == 2) & component.isin(*T.STATE_CODES)
    return F.coalesce(F.try_element_at(lookup(T.STATES), component), F.when(bare, component))


def canonical_address_token(t: Column) -> Column:
    t = F.when(t.rlike(r"^\p{Nd}+$"), F.regexp_replace(t, "^0+(?!$)", "")).otherwise(t)
    t = F.coalesce(F.try_element_at(lookup(T.STREET_TYPES), t), t)
    t = F.coalesce(F.try_element_at(lookup(T.CITY_ALIASES), t), t)
    return F.when(t.endswith("cdp") & (F.length(t) > 3), F.substr(t, F.lit(1), F.length(t) - 3)).otherwise(t)


def normalize_addresses(df: DataFrame, raw: str = "business_address", native_state: Column | None = None) -> DataFrame:
    """Add addr_norm, addr_state, addr_numbers, addr_postcode, addr_house, addr_has_native, addr_ncomp."""
    if "_nfkc" not in df.columns:
        df = prepared(df, _nfkc=("nfkc", raw))
    df = df.withColumn("_null", is_null(F.col(raw)))
    parts = F.transform(F.split("_nfkc", ","), lambda x: F.btrim(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")))
    df = df.withColumn("_c", F.when(F.col("_null"), F.array().cast("array<string>")).otherwise(F.filter(parts, lambda x: ~is_null(x))))
    df = df.withColumn("addr_ncomp", F.size("_c"))
    df = df.withColumn("addr_has_native", F.exists("_c", lambda x: x.rlike(T.INDIC)))
    # components never hold a comma, so the joined text can be romanised in one call
    df = df.withColumn("_k", F.transform(F.split(romanize(F.array_join("_c", ",")), ","), lambda x: F.rtrim(F.btrim(x), F.lit("."))))
    native = F.lit(None).cast("string")
    df = df.withColumn("_n", F.transform("_c", lambda x: F.when(x.rlike(T.INDIC), F.try_element_at(native_state, x)) if native_state is not None else native))
    several = F.col("addr_ncomp") > 1
    df = df.withColumn("_z", F.when(F.size("_c") == 0, F.array().cast("array<struct<k:string,s:string>>")).otherwise(
        F.transform("_k", lambda k, i: F.struct(k.alias("k"), F.coalesce(F.get("_n", i), state_of(k, several)).alias("s")))
    ))
    df = df.withColumn("addr_state", F.coalesce(F.get(F.filter("_z", lambda z: z["s"].isNotNull()), F.lit(0))["s"], F.lit("")))
    kept = F.array_join(F.transform(F.filter("_z", lambda z: z["s"].isNull()), lambda z: z["k"]), " ")
    df = df.withColumn("_t", F.filter(F.transform(tokens(clean_text(kept)), canonical_address_token), lambda x: ~x.isin(*T.ADDRESS_DROP)))
    glued = (F.col("addr_state") != "") & (F.try_element_at("_t", F.lit(-1)) == F.col("addr_state"))
    df = df.withColumn("_t", F.when(F.coalesce(glued, F.lit(False)), F.slice("_t", 1, F.size("_t") - 1)).otherwise(F.col("_t")))
    df = df.withColumn("addr_norm", F.array_join("_t", " "))
    return df.withColumns({
        "addr_numbers": F.array_join(F.regexp_extract_all("addr_norm", F.lit(r"\d+(?:[a-z](?![a-z]))?"), F.lit(0)), " "),
        "addr_postcode": F.coalesce(F.try_element_at(F.regexp_extract_all("addr_norm", F.lit(r"\b\d{5,6}\b"), F.lit(0)), F.lit(-1)), F.lit("")),
        "addr_house": F.regexp_extract("addr_norm", r"\d+", 0),
    }).drop("_null", "_nfkc", "_c", "_k", "_n", "_z", "_t")


def normalize(df: DataFrame, native_token: Column | None = None, native_state: Column | None = None) -> DataFrame:
    """A record table with the 14 derived columns."""
    df = prepared(df, _fold=("fold", "business_name"), _nfkc=("nfkc", "business_address"))
    return normalize_addresses(normalize_names(df, native_token=native_token), native_state=native_state)


def s1_state(c: Column) -> Column:
    """The code of the first comma component that is a state's name, else null."""
    parts = F.transform(F.split(romanize(F.coalesce(c, F.lit(""))), ","), lambda x: F.btrim(x))
    return F.get(F.filter(F.transform(parts, lambda x: F.try_element_at(lookup(T.STATES), x)), lambda x: x.isNotNull()), F.lit(0))
