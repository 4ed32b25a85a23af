"""Format-preserving pseudonyms by keyed Feistel permutations.

A value that passes its kind's validation (check digits, calendar, number ranges) becomes a whole number
below the count of valid values of its format, a keyed permutation of that range maps it to another,
and that is written in the same format. The permutation depends on the key, the kind and the range
alone, so equal values stay equal in all documents and different ones stay different. Numbers written with other
separators are equal values, and so are dates however they are written if their order can be told: year first,
day first with points, month spelled. Of those with slashes or hyphens and the year last, month and day can't be told
apart; they are linked among themselves, whatever their separator. Dates of 1900-2099 become such dates, those of
the other years from 1000 to 2999 one of those. An address keeps its domain.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from calendar import isleap
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "iban", "ip", "date", "ssn", "card", "phone")


def permute(x: int, n: int, key: bytes, tweak: str, inverse: bool = False) -> int:
    """The image of ``x`` under a keyed permutation of ``range(n)``: a Feistel network over the next even
    number of bits, walked until it falls below ``n`` again."""
    if n < 2:
        return x
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1
    size = (half + 7) // 8
    person = hashlib.blake2b(tweak.encode(), digest_size=16).digest()
    order = range(ROUNDS - 1, -1, -1) if inverse else range(ROUNDS)
    while True:
        a, b = x >> half, x & mask
        for r in order:
            if inverse:
                a, b = b ^ _round(a, r, size, mask, key, person), a
            else:
                a, b = b, a ^ _round(b, r, size, mask, key, person)
        x = a << half | b
        if x < n:
            return x


def _round(v: int, r: int, size: int, mask: int, key: bytes, person: bytes) -> int:
    data = bytes([r]) + v.to_bytes(size, "big")
    out, block = b"", 0
    while len(out) < size:
        out += hashlib.blake2b(bytes([block]) + data, key=key, person=person).digest()
        block += 1
    return int.from_bytes(out[:size], "big") & mask


def luhn_digit(digits: str) -> int:
    """The check digit that completes ``digits``."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 else 2 * d - 9 * (d > 4)
    return -total % 10


def _fill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _number(digits: str, key: bytes, tweak: str) -> str:
    return str(permute(int(digits), 10 ** len(digits), key, f"{tweak}{len(digits)}")).zfill(len(digits))


def _card(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or int(d[-1]) != luhn_digit(d[:-1]):
        return None
    body = _number(d[:-1], key, "card")
    return _fill(m[0], body + str(luhn_digit(body)))


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = [int(o) for o in m[0].split(".")]
    if max(octets) > 255 or any(len(o) > 1 and o[0] == "0" for o in m[0].split(".")):
        return None
    x = permute(int.from_bytes(bytes(octets), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, x.to_bytes(4, "big")))


def _ssn(m: re.Match, key: bytes) -> str | None:
    a, g, s = (int(x) for x in m[0].split("-"))
    if a in (0, 666) or a >= 900 or g == 0 or s == 0:
        return None
    x = ((a - 1 - (a > 666)) * 99 + g - 1) * 9999 + s - 1
    x, s = divmod(permute(x, 898 * 99 * 9999, key, "ssn"), 9999)
    a, g = divmod(x, 99)
    a += 1 + (a >= 665)
    return f"{a:03d}-{g + 1:02d}-{s + 1:04d}"


#: Years that dates are moved within: the usual ones among themselves, and the rest of these.
_NEAR, _FAR = range(1900, 2100), [*range(1000, 1900), *range(2100, 3000)]
_MONTHS = "January February March April May June July August September October November December".split()


def _years(year: int) -> tuple[str, list[int] | range] | None:
    return ("", _NEAR) if year in _NEAR else ("far", _FAR) if 1000 <= year < 3000 else None


@lru_cache(maxsize=4)
def _forms(leap: bool, numeric: bool) -> tuple[list[tuple[int, int]], dict[tuple[int, int], int]]:
    """All (month, day) of a year in order, and their places; numeric ones have those as well that can only be day first."""
    found = []
    d = date(2000 if leap else 2001, 1, 1)
    while d.year < 2002 - leap:
        found.append((d.month, d.day))
        if numeric and d.day > 12:
            found.append((d.day, d.month))
        d += timedelta(days=1)
    return found, {x: i for i, x in enumerate(found)}


@lru_cache(maxsize=4)
def _starts(far: str, numeric: bool) -> list[int]:
    """Before each year the number of dates in the years before it, and that of all at the end."""
    return list(accumulate((len(_forms(isleap(y), numeric)[0]) for y in (_FAR if far else _NEAR)), initial=0))


def _moved(year: int, first: int, second: int, key: bytes, numeric: bool = False) -> tuple[int, int, int] | None:
    """The pseudonym of a date as (year, first, second): month and day, or for numeric forms either of which may be first."""
    if (found := _years(year)) is None:
        return None
    far, years = found
    at = _forms(isleap(year), numeric)[1].get((first, second))
    if at is None:
        return None
    starts = _starts(far, numeric)
    to = permute(starts[years.index(year)] + at, starts[-1], key, f"date{far}{'?' if numeric else ''}")
    i = bisect_right(starts, to) - 1
    return (years[i], *_forms(isleap(years[i]), numeric)[0][to - starts[i]])


def _padded(value: int, like: str) -> str:
    return f"{value:0{len(like)}d}"


def _date(m: re.Match, key: bytes) -> str | None:
    sep, b, c = m["sep"], m["b"], m["c"]
    if not m["y"] and sep != ".":  # month first or day first: which can't be told, so both are one range of values
        new = _moved(int(c), int(m["a"]), int(b), key, numeric=True)
        return new and sep.join((_padded(new[1], m["a"]), _padded(new[2], b), f"{new[0]:04d}"))
    year, month, day = (m["y"], b, c) if m["y"] else (c, b, m["a"])
    new = _moved(int(year), int(month), int(day), key)
    if new is None:
        return None
    parts = [f"{new[0]:04d}", _padded(new[1], month), _padded(new[2], day)]
    return sep.join(parts if m["y"] else parts[::-1])


def _spelled(m: re.Match, key: bytes) -> str | None:
    """12 March 1999, March 12, 1999 and the like; full and short names of months are the same values."""
    name, day = m["m1"] or m["m2"], m["d1"] or m["d2"]
    month = next((i for i, x in enumerate(_MONTHS, 1) if name in (x, x[:3])), 0)
    moved = _moved(int(m["y"]), month, int(day), key)
    if moved is None:
        return None
    year, month, to = moved
    new = _MONTHS[month - 1][: None if len(name) > 3 or name == "May" else 3]
    parts = [(m.start(g) - m.start(), m.end(g) - m.start(), t) for g, t in (("d1", _padded(to, day)), ("m1", new), ("m2", new), ("d2", _padded(to, day)), ("y", f"{year:04d}")) if m[g]]
    out, last = "", 0
    for start, end, t in parts:
        out += m[0][last:start] + t
        last = end
    return out


def _phone(m: re.Match, key: bytes) -> str | None:
    d = _digits(m[0])
    if not 8 <= len(d) <= 15:
        return None
    fixed = _digits(m["cc"] or "")
    return _fill(m[0], fixed + _number(d[len(fixed) :], key, "phone"))


@lru_cache(maxsize=4096)
def _alphabet(c: str) -> str:
    """The characters that one may become: ASCII letters of its case, digits, of other cased letters those of its case
    among the 64 code points around it, else itself."""
    if c.isascii():
        return "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else "0123456789" if c.isdigit() else c
    if not _is_cased(c):
        return c
    base = ord(c) & ~63
    return "".join(x for x in map(chr, range(base, base + 64)) if _is_cased(x) and x.islower() == c.islower())


def _is_cased(c: str) -> bool:
    return c.isalpha() and c.lower() != c.upper()


def _alphabetic(text: str, key: bytes, tweak: str) -> str:
    """Letters to letters of the same case and digits to digits; the rest stays."""
    alphabets = [_alphabet(c) for c in text]
    n, x = 1, 0
    for c, letters in zip(text, alphabets):
        n *= len(letters)
        x = x * len(letters) + letters.index(c)
    x = permute(x, n, key, tweak + "".join("a" if c.isascii() and c.isalpha() else letters[0] for c, letters in zip(text, alphabets)))
    out = []
    for letters in reversed(alphabets):
        x, r = divmod(x, len(letters))
        out.append(letters[r])
    return "".join(reversed(out))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(m: re.Match, key: bytes) -> str | None:
    flat = m[0].replace(" ", "")
    if not 15 <= len(flat) <= 34 or int(flat[2:4]) != _iban_check(flat[:2], flat[4:]):
        return None
    body = _alphabetic(flat[4:], key, f"iban{flat[:2]}")
    it = iter(f"{flat[:2]}{_iban_check(flat[:2], body):02d}{body}")
    return "".join(next(it) if c != " " else c for c in m[0])


_OCTET = r"[0-9]{1,3}"
_NAMES = "|".join([*_MONTHS, *[x[:3] for x in _MONTHS if x != "May"]])
#: In order of precedence where matches begin together.
_RULES: list[tuple[str, re.Pattern, Callable[[re.Match, bytes], str | None]]] = [
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"), _iban),
    ("ip", re.compile(rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"), _ip),
    ("date", re.compile(r"(?<![0-9./-])(?:(?P<y>[0-9]{4})|(?P<a>[0-9]{1,2}))(?P<sep>[-/.])(?P<b>[0-9]{1,2})(?P=sep)(?P<c>(?(y)[0-9]{1,2}|[0-9]{4}))(?![0-9]|[-/.][0-9])"), _date),
    ("date", re.compile(rf"\b(?:(?P<d1>[0-9]{{1,2}})\x20(?P<m1>{_NAMES})|(?P<m2>{_NAMES})\x20(?P<d2>[0-9]{{1,2}}),?)\x20(?P<y>[0-9]{{4}})\b"), _spelled),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"), _ssn),
    ("card", re.compile(r"(?<![0-9.-])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{1,7}|[0-9]{4}(?P<t>[ -])[0-9]{6}(?P=t)[0-9]{5})(?![0-9]|[.-][0-9])"), _card),
    ("phone", re.compile(r"(?<![0-9.+])(?:(?P<cc>\+[0-9]{1,3}[ .-]?)(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,5}(?:[ .-][0-9]{2,5}){0,4}|\([0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9]|[.-][0-9])"), _phone),
]
_MAY = re.compile(r"[0-9]")
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Letters that are permuted together; what is longer is cut into pieces of so many.
_PIECE = 64


@lru_cache(maxsize=100_000)
def _email(local: str, domain: str, key: bytes) -> str:
    pieces = [local[at : at + _PIECE] for at in range(0, len(local), _PIECE)]
    return "".join(_alphabetic(p, key, f"email{n or ''}{domain.lower()}") for n, p in enumerate(pieces)) + domain


def _emails(text: str, key: bytes) -> Iterator[tuple[int, int, int, str, str]]:
    """Addresses; the local part is read back to where it begins, whatever its length."""
    last = 0
    for m in _AT.finditer(text):
        at = m.start()
        while at > last and (text[at - 1] in _LOCAL or not text[at - 1].isascii() and _is_cased(text[at - 1])):
            at -= 1
        while at < m.start() and text[at] == ".":
            at += 1
        if at < m.start():
            yield at, -1, m.end(), "email", _email(text[at : m.start()], m[0], key)
        last = m.end()


def find(text: str, key: bytes) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each value, disjoint, in order of start."""
    found = []
    if "@" in text:
        found += _emails(text, key)
    if _MAY.search(text):
        for n, (kind, pattern, change) in enumerate(_RULES):
            for m in pattern.finditer(text):
                new = change(m, key)
                if new is not None:
                    found.append((m.start(), n, m.end(), kind, new))
    found.sort(key=lambda f: (f[0], f[1]))
    out, last = [], 0
    for start, _, end, kind, new in found:
        if start >= last:
            out.append((start, end, kind, new))
            last = end
    return out


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with its values replaced, and what was replaced where."""
    found = find(text, key)
    parts, last = [], 0
    for start, end, _, new in found:
        parts += [text[last:start], new]
        last = end
    return ("".join(parts) + text[last:] if found else text), found


def transform(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str = "pii") -> DataFrame:
    """``docs`` with ``text_col`` pseudonymised and a column of what was replaced.

    ``spans_col`` holds ``(kind, start, end)`` in code points of the original text, in order. Null texts
    stay null with no spans, empty texts stay empty. Values that fail their validation are left alone.
    Other columns pass through, whatever their names; a column named ``spans_col`` must not exist. Rows
    are independent: no order, no shuffle, repeated rows give repeated results.
    """
    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")
    span = "array<struct<kind:string,start:long,end:long>>"
    names = docs.columns
    if spans_col in names:
        raise ValueError(f"column {spans_col} exists")
    at = names.index(text_col)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, spans = [], []
            for t in b.column(at).to_pylist():
                new, found = pseudonymise(t, key) if t else (t, [])
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for s, e, k, _ in found])
            cols = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(spans, kind)], names=[*names, spans_col])

    fields = ", ".join(f"`{n}` {t}" for n, t in docs.dtypes)
    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, f"{fields}, `{spans_col}` {span}")
