"""PII: format-preserving Feistel pseudonyms.

Personal values are found by pattern, validated (Luhn, octets, calendar, area codes,
mod 97) and mapped by a keyed permutation of all values of their format: a Feistel
network over two halves of the domain, walked on until it lands inside.  Equal
values get equal pseudonyms in every document, different ones different ones, and
whoever holds the key can invert the map.  What fails its validation is no personal
value and stays as it is.  Only an IPv4 address may change its length.

Numbers (phone, IPv4, card, social security number, date) are permuted as one number.
Texts of letters and digits (the others) are halved, and each round adds a stream of
digits, keyed by one half, to the other, each within its alphabet: linear time at any
length.

Kinds: e-mail (the local part and first host label; the rest of the host stays), phone,
IPv4, payment card (plain, 4-4-4-4 or 4-6-5), social security number, IBAN (plain, or in
fours for the countries of `IBAN_LENGTHS`), date (1900 to 2099, as year-month-day,
day/month/year or day.month.year; month/day/year where day/month/year is no date), access
key id, and the value of a token, password, secret or API key.  Letters are permuted
without regard to case and put back in the case they had.  The same value gets the same
pseudonym in each grouping; a date in month/day order keeps its own links.

Defined cases
* null text stays null, empty text empty; texts are scanned whole, and values of any length
  permuted whole, in time linear in the text;
* overlapping candidates: the leftmost, then the kind named first in `PATTERNS`;
* repeated rows are treated alike; an empty table gives an empty result;
* other columns are ignored by `find`, and kept by `pseudonymize`.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillworks.llm.common import small_batches

ROUNDS = 8


class Permutation:
    """Keyed permutations of range(size), one per (size, kind), and of texts over alphabets, or their inverses.

    Called with (kind, size, value) it maps a number, `text` maps a list of digits.
    """

    def __init__(self, key: bytes, inverse: bool = False):
        if not key:
            raise ValueError("a key is needed")
        self.key, self.inverse = hashlib.blake2b(key, digest_size=32).digest(), inverse
        self.steps = list(reversed(range(ROUNDS))) if inverse else list(range(ROUNDS))
        self.of = lru_cache(maxsize=100_000)(self._of)

    def __call__(self, kind: str, size: int, value: int) -> int:
        return self.of(kind, size, value)

    def _round(self, kind: str, step: int, size: int, value: int) -> int:
        message = b"%s|%d|%d|%d" % (kind.encode(), step, size, value)
        return int.from_bytes(hashlib.blake2b(message, key=self.key, digest_size=32).digest())

    def _once(self, kind: str, size: int, a: int, b: int, value: int) -> int:
        left, right = divmod(value, b)
        sign = -1 if self.inverse else 1
        for step in self.steps:
            if step % 2:
                right = (right + sign * self._round(kind, step, size, left)) % b
            else:
                left = (left + sign * self._round(kind, step, size, right)) % a
        return left * b + right

    def _of(self, kind: str, size: int, value: int) -> int:
        if size < 2:
            return value
        a = math.isqrt(size - 1) + 1
        b = -(-size // a)
        value = self._once(kind, size, a, b, value)
        while value >= size:  # walk the cycle until it is back in the format
            value = self._once(kind, size, a, b, value)
        return value

    def text(self, kind: str, bases: np.ndarray, digits: np.ndarray) -> np.ndarray:
        """Digits, each below its base, permuted together; bases and digits in 32 bits."""
        n = len(digits)
        if n < 2:
            return np.array([self(kind, int(b), int(d)) for b, d in zip(bases, digits)], dtype=np.int32)
        cut, digits = n // 2, digits.copy()
        halves = (slice(0, cut), slice(cut, n))
        for step in self.steps:
            own, other = halves[step % 2], halves[1 - step % 2]
            message = hashlib.shake_256(self.key + b"%s|%d|" % (kind.encode(), step) + bases.astype("<u1").tobytes() + digits[other].astype("<u1").tobytes())
            stream = np.frombuffer(message.digest(4 * (own.stop - own.start)), "<u4") % bases[own].astype(np.uint32)
            moved = digits[own] + stream.astype(np.int32) * (-1 if self.inverse else 1)
            digits[own] = moved % bases[own]
        return digits


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_SOME_DIGIT = re.compile(r"[0-9]")
_DIGITS, _LOWER, _UPPER, _BOTH = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
#: ASCII code -> its alphabet (0: none, then digits, lower and upper case), and its place in it.
_CLASS, _PLACE = np.zeros(128, dtype=np.int8), np.zeros(128, dtype=np.int32)
for _n, _set in enumerate((_DIGITS, _LOWER, _UPPER), 1):
    _CLASS[[ord(c) for c in _set]], _PLACE[[ord(c) for c in _set]] = _n, range(len(_set))
_SIZES, _FIRST_CODE = np.array([1, 10, 26, 26], dtype=np.int32), np.array([0, ord("0"), ord("a"), ord("A")], dtype=np.int32)


def _letters(kind: str, text: str, to: Permutation) -> str:
    """Permute the ASCII letters and digits of a text together, each within its class; the rest stays."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int32)
    ascii_ = np.where(codes < 128, codes, 0)
    spots = np.flatnonzero(_CLASS[ascii_])
    of = _CLASS[ascii_[spots]]
    codes[spots] = _FIRST_CODE[of] + to.text(kind, _SIZES[of], _PLACE[ascii_[spots]])
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _over(kind: str, text: str, alphabet: str, to: Permutation) -> str:
    """Permute a text whose every character is one of `alphabet`."""
    codes = np.array([ord(c) for c in alphabet], dtype=np.uint8)
    place = np.zeros(128, dtype=np.int32)
    place[codes] = np.arange(len(codes))
    digits = place[np.frombuffer(text.encode(), np.uint8)]
    return codes[to.text(kind, np.full(len(digits), len(codes), dtype=np.int32), digits)].tobytes().decode()


def _refill(text: str, digits: str) -> str:
    """`digits` in the places of the digits of `text`."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _phone(text: str, to: Permutation) -> str | None:
    digits = _digits(text)
    own = digits[-10:]
    return _refill(text, digits[:-10] + f"{to('phone', 10**10, int(own)):010d}")


def _ip(text: str, to: Permutation) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    value = to("ip", 1 << 32, int.from_bytes(bytes(map(int, parts))))
    return ".".join(map(str, value.to_bytes(4)))


def _card(text: str, to: Permutation) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or not luhn(digits) or not int(digits):
        return None
    n = len(digits) - 1
    new = f"{to('card', 10**n - 1, int(digits[:n]) - 1) + 1:0{n}d}"  # not zero
    return _refill(text, next(new + c for c in "0123456789" if luhn(new + c)))


def _ssn(text: str, to: Permutation) -> str | None:
    area, group, serial = map(int, text.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    value = to("ssn", 898 * 99 * 9999, ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1)
    value, serial = divmod(value, 9999)
    area, group = divmod(value, 99)
    return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"


#: Lengths of international bank account numbers by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GI": 23, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24,
    "SI": 19, "SK": 24, "SM": 27, "TR": 26, "UA": 29,
}


def _iban(text: str, to: Permutation) -> str | None:
    """Plain, or in fours: then as many characters as the country's numbers have, and what follows them stays."""
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if " " in text:
        size = IBAN_LENGTHS.get(text[:2], 0)
        end = size + (size - 1) // 4 if size else 0
        if not end or len(text) < end or text[end : end + 1] not in ("", " "):
            return None
        text, rest = text[:end], text[end:]
    else:
        rest = ""
    plain = text.replace(" ", "")
    if number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    account = _letters("iban" + plain[:2], plain[4:], to)
    new = iter(f"{plain[:2]}{98 - number(account + plain[:2] + '00') % 97:02d}{account}")
    return "".join(c if c == " " else next(new) for c in text) + rest


_FIRST = datetime.date(1900, 1, 1)
_DAYS = (datetime.date(2100, 1, 1) - _FIRST).days


def _day(year: str, month: str, day: str) -> int | None:
    """Days since 1900, of a date up to 2099."""
    try:
        at = (datetime.date(int(year), int(month), int(day)) - _FIRST).days
    except ValueError:
        return None
    return at if 0 <= at < _DAYS else None


def _date(text: str, to: Permutation) -> str | None:
    fields = re.split(r"[^0-9]", text)
    american = False
    if len(fields[0]) == 4:
        at = _day(*fields)
    else:
        at = _day(*fields[::-1])
        if at is None and "/" in text:  # month/day/year, which can't be read the other way
            at, american = _day(fields[2], fields[0], fields[1]), True
    if at is None:
        return None
    new = _FIRST + datetime.timedelta(days=to("date", _DAYS, at))
    while american and new.day <= 12:
        new = _FIRST + datetime.timedelta(days=to("date", _DAYS, (new - _FIRST).days))
    if len(fields[0]) == 4:
        return _refill(text, f"{new.year:04d}{new.month:02d}{new.day:02d}")
    return _refill(text, f"{new.month:02d}{new.day:02d}{new.year:04d}" if american else f"{new.day:02d}{new.month:02d}{new.year:04d}")


def _email(text: str, to: Permutation) -> str | None:
    local, _, host = text.partition("@")
    label, dot, rest = host.partition(".")
    return _letters("email", f"{local}@{label}", to) + dot + rest


def _access_key(text: str, to: Permutation) -> str | None:
    return text[:4] + _over("access key", text[4:], _BOTH, to)


def _secret(text: str, to: Permutation) -> str | None:
    """The value after the sign.  Hexadecimal values map to such with a digit, others to others: both walk on until they do."""
    start = re.match(r"\w+\s*[=:]\s*[\"']?", text).end()
    value = text[start:]
    if not _SOME_DIGIT.search(value):
        return None
    if _HEX.fullmatch(value):
        upper = value.upper() == value
        value = _over("hex", value.lower(), "0123456789abcdef", to)
        while not _SOME_DIGIT.search(value):
            value = _over("hex", value, "0123456789abcdef", to)
        return text[:start] + (value.upper() if upper else value)
    value = _letters("secret", value, to)
    while _HEX.fullmatch(value):
        value = _letters("secret", value, to)
    return text[:start] + value


#: kind, pattern, validation and map.  A match that fails validation is left alone.
PATTERNS: list[tuple[str, str, Callable[[str, Permutation], str | None]]] = [
    ("secret", r"(?i:\b(?:token|password|passwd|secret|api_?key)\s*[=:]\s*[\"']?)[0-9A-Za-z]{8,}", _secret),
    ("access_key", r"\bA[KS]IA[A-Z0-9]{16}\b", _access_key),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)\b", _iban),
    ("phone", r"(?:(?<![\w+])\+[0-9]{1,3}[ -]?)?(?:\([0-9]{3}\) ?|(?<![\w.+-])[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![\w-]|\.[0-9])", _phone),
    ("ssn", r"(?<![\w.-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-]|\.[0-9])", _ssn),
    ("ip", r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])", _ip),
    ("date", r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![\w/-]|\.[0-9])", _date),
    ("card", r"(?<![\w.-])(?:[0-9]{13,19}|[0-9]{4}(?P<gap>[ -])(?:[0-9]{4}(?P=gap)[0-9]{4}(?P=gap)[0-9]{4}|[0-9]{6}(?P=gap)[0-9]{5}))(?![\w-]|\.[0-9])", _card),
]
#: Tried once per run of local-part characters, from its start: a run without "@" costs its length, not its square.
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[._%+-]*([A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})")
KINDS = ["email", *(kind for kind, _, _ in PATTERNS)]
_MAPS = {kind: fn for kind, _, fn in PATTERNS}


#: One scan for all kinds but e-mail.
NUMBERS = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern, _ in PATTERNS))


def spans(text: str | None, to: Permutation) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym) of each personal value, in order, in code points."""
    if not text:
        return []
    found = []
    if "@" in text:
        found = [(m.start(1), m.end(), "email", _email(m.group(1), to)) for m in EMAIL.finditer(text)]
    if _SOME_DIGIT.search(text) or "KIA" in text or "SIA" in text:  # all kinds hold digits, but an access key need not
        at = 0
        while m := NUMBERS.search(text, at):
            new = _MAPS[m.lastgroup if m.lastgroup != "gap" else "card"](m.group(), to)
            if new is not None:
                found.append((m.start(), m.end(), "card" if m.lastgroup == "gap" else m.lastgroup, new))
            at = m.end() if new is not None else m.start() + 1
    found.sort(key=lambda s: s[:2])
    out: list[tuple[int, int, str, str]] = []
    for span in found:
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def replace(text: str | None, to: Permutation) -> tuple[str | None, list[tuple[int, int, str, str]]]:
    found = spans(text, to)
    if not found:
        return text, found
    out, last = [], 0
    for start, end, _, new in found:
        out += text[last:start], new
        last = end
    return "".join(out) + text[last:], found


def find(docs: DataFrame, key: bytes) -> DataFrame:
    """One row per personal value: doc_id, start, length, kind, pseudonym."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Permutation(key)
        for batch in batches:
            rows = [
                (doc_id, start, end - start, kind, new)
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for start, end, kind, new in spans(text, to)
            ]
            columns = list(zip(*rows)) or [()] * 5
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "start", "length", "kind", "pseudonym"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start long, length long, kind string, pseudonym string")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """(row, new_text, n_replaced, kinds): the columns of `docs` in a struct; kinds as "card 2, email 1"."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = Permutation(key)
        for batch in batches:
            done = [replace(text, to) for text in batch.column(0).field("text").to_pylist()]
            kinds = [", ".join(f"{k} {n}" for k, n in sorted(Counter(s[2] for s in found).items())) for _, found in done]
            arrays = [pa.array([t for t, _ in done], pa.string()), pa.array([len(f) for _, f in done], pa.int64()), pa.array(kinds, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["row", "new_text", "n_replaced", "kinds"])

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    more = [T.StructField("new_text", T.StringType()), T.StructField("n_replaced", T.LongType()), T.StructField("kinds", T.StringType())]
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *more]))


def pseudonymize_documents(docs: DataFrame, key: bytes) -> DataFrame:
    """The columns of `docs`, with pseudonyms in the text."""
    out = pseudonymize(docs, key)
    return out.select(*[F.col("new_text").alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
