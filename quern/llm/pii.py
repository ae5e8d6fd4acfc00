"""Format-preserving pseudonyms for personal data by a keyed Feistel cipher.

Found and validated: card numbers (13 to 19 digits, Luhn), telephone numbers (international or North American form),
IPv4 addresses (octets up to 255, host part), national identifiers of the form 3-2-4 digits, IBANs (mod 97), dates
(year first, or day and month with a separator; checked against the calendar), and e-mail addresses. Each value is
permuted within its format: digits stay digits, letters letters, separators stay, check digits are computed anew, dates
stay dates of the same form, octets stay octets. The permutation is a Feistel network over two halves of the value's
number space with a keyed hash as round function, walked until the result is in the format again, so it is a bijection:
equal values get equal pseudonyms in every document and different ones stay different. In small number spaces the
network carries a rotation, which leaves no value as it was; in large ones a value that comes out unchanged (one in the
size of the space) isn't counted. Values that fail validation are left as they are.

Links hold across these spellings: cards, IBANs and phones with other separators; North American phones with and without
+1; dates year first, month first, and with two-place day and month. Dates with one-place parts and slash dates with the day
first have permutations of their own by form, since not every day has a spelling in them. Cards, IBANs and phones are also looked for in the shorter and later runs of whole groups of a run that fails
validation, and the search goes on right after a rejected start. Of runs that overlap, a card in a printed form (one
group, 4-4-4-4, 4-6-5 or 4-6-4) goes first.

The key is a required argument. Without it the pseudonyms can't be reversed; with it ``back`` gives the original value, unless
a pseudonym makes a longer run with its neighbours valid that wasn't before.

Edge cases: null and empty texts stay as they are; values that touch a letter or digit on either side are no values; a
document may hold any number of values; rows with equal doc_id are rows of their own; an empty table gives an empty
result; other columns pass through, but for n_<kind>, which the counts replace.
"""

from __future__ import annotations

import hmac
import re
import unicodedata
from calendar import monthrange
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quern.llm._text import fresh

ROUNDS = 8
KINDS = ("card", "iban", "date", "ip", "ssn", "phone", "email")

#: One alternative for each kind, tried in this order at each place.
PATTERN = re.compile(
    r"(?<![\w.])(?P<email>\w[\w.%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24})(?![A-Za-z0-9])"
    r"|(?<![\w])(?P<iban>[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![\w])"
    r"|(?<![\w.-])(?P<date>[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}|[0-9]{1,2}-[0-9]{1,2}-[0-9]{4})(?![\w-])(?!\.[0-9])"
    r"|(?<![\w.])(?P<ip>[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})(?!\w)(?!\.[0-9])"
    r"|(?<![\w-])(?P<ssn>[0-9]{3}-[0-9]{2}-[0-9]{4})(?![\w-])"
    r"|(?<![\w.])(?P<card>[0-9](?:[ -]?[0-9]){12,18})(?!\w)(?!\.[0-9])"
    r"|(?<!\w)(?P<phone>\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?!\w)"
)


def feistel(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of 0..size-1: a Feistel network on the next even number of bits, walked back into range."""
    if size <= 1:
        return value
    half = (max(2, (size - 1).bit_length()) + 1) // 2
    mask = (1 << half) - 1
    rounds = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    while True:
        left, right = value >> half, value & mask
        for r in rounds:
            if back:
                left, right = right ^ _round(key, tweak, r, left, half), left
            else:
                left, right = right, left ^ _round(key, tweak, r, right, half)
        value = (left << half) | right
        if value < size:
            return value


#: Number spaces below this size are permuted without a fixed point.
SMALL_SPACE = 1 << 20


def moved(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """``feistel``, in small spaces as a rotation between the network and its inverse, so that no value stays."""
    if not 1 < size < SMALL_SPACE:
        return feistel(value, size, key, tweak, back)
    shift = 1 + int.from_bytes(hmac.digest(key, b"shift|" + tweak, "sha256"), "big") % (size - 1)
    return feistel((feistel(value, size, key, tweak) + (-shift if back else shift)) % size, size, key, tweak, True)


def _round(key: bytes, tweak: bytes, r: int, x: int, bits: int) -> int:
    digest = hmac.digest(key, b"%d|%d|%d|" % (r, bits, x) + tweak, "sha256")
    return int.from_bytes(digest, "big") & ((1 << bits) - 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, ch in enumerate(reversed(digits)):
        d = int(ch) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def refill(like: str, digits: str) -> str:
    """The digits in the places of the digits of ``like``."""
    it = iter(digits)
    return "".join(next(it) if ch.isdigit() else ch for ch in like)


def _number(digits: str, key: bytes, tweak: str, back: bool) -> str:
    """A permutation of all digit strings of this length."""
    return str(moved(int(digits), 10 ** len(digits), key, tweak.encode(), back)).zfill(len(digits))


def card(value: str, key: bytes, back: bool = False) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    body = digits[:-1]
    while True:  # a string of one digit repeated is no card number, so the walk passes over it
        body = _number(body, key, f"card{len(digits)}", back)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        if len(set(full)) > 1:
            return refill(value, full)


def ip(value: str, key: bytes, back: bool = False) -> str | None:
    octets = value.split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    n = feistel(int.from_bytes(bytes(map(int, octets)), "big"), 1 << 32, key, b"ip", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def ssn(value: str, key: bytes, back: bool = False) -> str | None:
    """Area 001 to 899 but 666, group from 01, serial from 0001."""

    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = value.replace("-", "")
    if not valid(digits):
        return None
    while True:
        digits = _number(digits, key, "ssn", back)
        if valid(digits):
            return refill(value, digits)


def phone(value: str, key: bytes, back: bool = False) -> str | None:
    """The country code (after +, up to the first separator) stays, the subscriber's digits are permuted.

    Ten digits after +1 or without a country code are one North American number.
    """
    m = re.match(r"\+[0-9]{1,3}(?=[ .(-])|\+[0-9]", value)
    head = m[0] if m else ""
    rest = value[len(head) :]
    digits = re.sub(r"\D", "", rest)
    if not 6 <= len(digits) <= 14:
        return None
    code = "+1" if not head and len(digits) == 10 else head
    return head + refill(rest, _number(digits, key, f"phone{code}", back))


def date(value: str, key: bytes, back: bool = False) -> str | None:
    """Days of the years 1900 to 2099; the order of day and month is kept where only one is possible, else day first."""
    parts = re.split(r"\D", value)
    sep = re.search(r"\D", value)[0]
    year_first = len(parts[0]) == 4
    if year_first:
        y, m, d = map(int, parts)
        month_first = True
    else:
        d, m, y = map(int, parts)
        # the slash form is read month first where that is a date
        month_first = sep == "/" and d <= 12
        if month_first:
            d, m = m, d
    if not 1900 <= y <= 2099 or not 1 <= m <= 12 or not 1 <= d <= monthrange(y, m)[1]:
        return None
    # the form: year first, month first or day first, and which of the two shorter numbers has two places
    widths = tuple(len(p) for p in parts)
    days = _days()
    # every day has a spelling in these forms, so they share a permutation of the days
    shared = year_first or (widths[:2] == (2, 2) and (month_first or sep != "/"))
    form = "date" if shared else f"date{year_first}{month_first}{sep}{widths}"
    n = days[0][(y, m, d)]
    while True:
        n = moved(n, len(days[1]), key, form.encode(), back)
        y, m, d = days[1][n]
        if year_first:
            return f"{y:04d}{sep}{m:02d}{sep}{d:02d}"
        a, b = (m, d) if month_first else (d, m)
        if sep == "/" and not month_first and a <= 12:
            continue  # would be read month first
        texts = [str(x).zfill(w) for x, w in zip((a, b), widths, strict=False)]
        if all(len(t) == w for t, w in zip(texts, widths, strict=False)):
            return f"{texts[0]}{sep}{texts[1]}{sep}{y:04d}"


@lru_cache(1)
def _days() -> tuple[dict[tuple[int, int, int], int], list[tuple[int, int, int]]]:
    every = [(y, m, d) for y in range(1900, 2100) for m in range(1, 13) for d in range(1, monthrange(y, m)[1] + 1)]
    return {x: i for i, x in enumerate(every)}, every


def iban(value: str, key: bytes, back: bool = False) -> str | None:
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain[4:] + plain[:4]) != 1:
        return None
    account = _symbols(plain[4:], key, f"iban{plain[:2]}", back)
    check = 98 - _mod97(account + plain[:2] + "00")
    out = iter(plain[:2] + f"{check:02d}" + account)
    return "".join(ch if ch == " " else next(out) for ch in value)


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s)) % 97


def email(value: str, key: bytes, back: bool = False) -> str | None:
    """Letters and digits of the local part, of any script, are permuted within their kinds; the domain stays."""
    local, domain = value.rsplit("@", 1)
    return f"{_symbols(local, key, 'email' + domain.lower(), back)}@{domain}"


@lru_cache(65536)
def _alphabet(c: str) -> tuple[str, int]:
    """The characters that ``c`` is permuted among, and its place: letters of one case (or none) or digits among the 128
    code points around it, whatever the script; other characters are alone."""
    kind = unicodedata.category(c)
    if kind[0] != "L" and kind != "Nd":
        return c, 0
    first = ord(c) & ~0x7F
    every = "".join(x for x in map(chr, range(first, first + 128)) if unicodedata.category(x) == kind)
    return every, every.index(c)


def _symbols(s: str, key: bytes, tweak: str, back: bool) -> str:
    """Permute a string among all that have characters of the same kinds in the same places."""
    value, size, shape = 0, 1, []
    for c in s:
        alphabet, i = _alphabet(c)
        value, size = value * len(alphabet) + i, size * len(alphabet)
        shape.append(alphabet[0])
    value = moved(value, size, key, f"{tweak}|{''.join(shape)}".encode(), back)
    out = []
    for c in reversed(s):
        alphabet, _ = _alphabet(c)
        value, i = divmod(value, len(alphabet))
        out.append(alphabet[i])
    return "".join(reversed(out))


#: Each alternative of PATTERN by itself, and the kinds in the order in which it tries them.
KINDS_IN_ORDER = tuple(sorted(PATTERN.groupindex, key=PATTERN.groupindex.get))
ALONE = {k: re.compile(x) for k, x in zip(KINDS_IN_ORDER, re.split(r"\|(?=\(\?<!\[?\\w)", PATTERN.pattern), strict=True)}
OF = {"card": card, "iban": iban, "date": date, "ip": ip, "ssn": ssn, "phone": phone, "email": email}


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with its values replaced, and how many of each kind."""
    found: dict[str, int] = {}
    out, done, at = [], 0, 0
    while m := PATTERN.search(text, at):
        start = m.start()
        at = start + 1
        for kind, end in _readings(text, m):
            new = OF[kind](text[start:end], key, back)
            if new is not None:
                if new != text[start:end]:
                    found[kind] = found.get(kind, 0) + 1
                out += text[done:start], new
                done = at = end
                break
    return "".join([*out, text[done:]]), found


def _readings(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """(kind, end) of the values that may start where ``m`` does: its own first, then those of the later kinds."""
    start = m.start()
    for kind in KINDS_IN_ORDER[KINDS_IN_ORDER.index(m.lastgroup) :]:
        own = m if kind == m.lastgroup else ALONE[kind].match(text, start)
        if own and kind == "card":
            yield from (("card", end) for end in _card_ends(text, start))
        elif own:
            yield kind, own.end()
            if kind in ("iban", "phone"):
                # upper-case words or digit groups that follow look like more of the value
                yield from ((kind, end) for end in range(own.end() - 1, start, -1) if text[end] == " " and ALONE[kind].fullmatch(text, start, end))


#: Sizes of the digit groups that cards are printed in, besides one group.
PRINTED = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
_GROUPS = re.compile(r"[0-9]+(?:[ -][0-9]+){0,18}")


def _card_runs(text: str, start: int) -> list[tuple[int, bool]]:
    """(end, printed) of the runs of whole digit groups from ``start`` with 13 to 19 digits, longest first."""
    sizes, runs = [], []
    for g in re.finditer(r"[0-9]+", _GROUPS.match(text, start)[0]):
        sizes.append(len(g[0]))
        if sum(sizes) > 19:
            break
        end = start + g.end()
        if sum(sizes) >= 13 and not re.compile(r"\w|\.[0-9]").match(text, end):
            runs.append((end, len(sizes) == 1 or tuple(sizes) in PRINTED))
    return runs[::-1]


def _valid_card(value: str) -> bool:
    digits = re.sub(r"\D", "", value)
    return luhn(digits) and len(set(digits)) > 1


def _card_ends(text: str, start: int) -> Iterator[int]:
    """Ends to try for a card at ``start``: printed forms first, then other runs that cut into no valid printed form."""
    runs = _card_runs(text, start)
    yield from (end for end, printed in runs if printed)
    for end, printed in runs:
        if not printed and _valid_card(text[start:end]):
            later = (start + g.start() for g in re.finditer(r"(?<=[ -])[0-9]", text[start:end]))
            if not any(p and _valid_card(text[i:e]) for i in later for e, p in _card_runs(text, i)):
                yield end


#: A text without a digit followed by another mark of a value can hold none.
_MAYBE = r"[0-9]|@"


def replace_pii(docs: DataFrame, key: bytes, counts: bool = True) -> DataFrame:
    """The rows of docs with ``text`` pseudonymised, and with ``counts`` a column n_<kind> for each kind."""
    extra = [f"n_{k}" for k in KINDS] if counts else []
    docs = docs.drop(*extra)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    names = [*docs.columns, *extra]
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh()
        for batch in batches:
            texts = batch.column("text")
            maybe = pc.fill_null(pc.match_substring_regex(texts, _MAYBE), False).to_numpy(zero_copy_only=False)
            tally = {k: [0] * batch.num_rows for k in KINDS}
            new: dict[int, str] = {}
            for i in maybe.nonzero()[0].tolist():
                text = texts[i].as_py()
                out, found = pseudonymise(text, key)
                for k, n in found.items():
                    tally[k][i] = n
                if out != text:
                    new[i] = out
            if new:
                mask = [i in new for i in range(batch.num_rows)]
                texts = pc.replace_with_mask(texts, pa.array(mask), pa.array([new[i] for i in sorted(new)], pa.string()))
            columns = list(batch.columns)
            columns[at] = texts
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(tally[k], pa.int32()) for k in KINDS if counts)], names=names)

    schema = ", ".join([fields, *(f"{x} int" for x in extra)])
    return docs.mapInArrow(run, schema)
