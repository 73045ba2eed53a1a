"""Format-preserving pseudonyms for personal data and secrets.

Each value that is found and validated is brought to a canonical form (a day, a
lower-cased address, all digits of a number), mapped to a number below the
count of all values of its kind, permuted by a keyed Feistel network over that
range (cycle-walking where the network's range is larger), and written back in
the format that was found. So a card number keeps its length, separators and
valid check digit, an IBAN its country, a telephone number its country code, a
date stays a date, and equal values get equal pseudonyms in all documents, in
whatever way they are written: 2020-03-04, 04.03.2020 and 4.3.2020 stay one
day, addresses in two cases one address. With the key, `reveal` undoes it.

Formats: e-mail addresses, IPv4 addresses, card numbers (13 to 19 digits with a
valid check digit), IBANs, US social security numbers, telephone numbers, dates
from 1900 to 2099 (ISO, also before a time; dotted, slashed, with English names
of months) and quoted or bare hexadecimal secrets
of 32 digits and more. Two properties of a day are kept, so that it can be read
back from any way of writing: whether its day comes after the 12th, and whether
day or month has one digit. With a month's name the leading zero of a day and
the short name may be lost on the way back (May is short and whole at once).

Defined results: null stays null; an empty text, or one without such values, is
unchanged. Bare runs of nine or ten digits are no telephone or security numbers
without their marks. Overlapping findings: the one that begins first counts, of those the
one listed first. A number that fails its format's validation is left alone. A
text of any length is read whole; every search is linear in its length.
Repeated rows are treated alike; an empty table gives an empty result. A column
with the name of the count of replacements is replaced by it; all others are
kept as they are.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable
from datetime import date, timedelta
from functools import cache
from math import isqrt

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .common import Texts, annotate

#: The session's setting with the secret key.
KEY_CONF = "spark.asofworks.pseudonyms.key"
ROUNDS = 8


#: A key that everybody knows, for tests and for the registered query and pipeline where a session names none: it hides nothing.
OPEN_KEY = b"known to all: name another key"


def session_key(spark: SparkSession, default: bytes | None = None) -> bytes:
    """The key of the session's setting; without it the caller's default, and an error where there is none."""
    key = spark.conf.get(KEY_CONF, "").encode() or default
    if not key:
        raise ValueError(f"set {KEY_CONF} to a secret key")
    return key


class Feistel:
    """Keyed permutations of range(size), one for each size and tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.blake2b(key, digest_size=32).digest()

    def _round(self, k: int, half: int, size: int, tweak: bytes) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d|%d|" % (k, half, size) + tweak, key=self.key, digest_size=32).digest(), "big")

    def permute(self, value: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return value
        a = isqrt(size - 1) + 1
        while True:
            left, right = divmod(value, a)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if k % 2 == 0:
                    left = (left + (-1 if back else 1) * self._round(k, right, size, tweak)) % a
                else:
                    right = (right + (-1 if back else 1) * self._round(k, left, size, tweak)) % a
            value = left * a + right
            if value < size:
                return value


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10 of digits with its last as the check digit."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10


def refill(shape: str, chars: str) -> str:
    """shape with its letters and digits replaced by chars in order."""
    new = iter(chars)
    return "".join(next(new) if c.isascii() and c.isalnum() else c for c in shape)


def spread(text: str, f: Feistel, tweak: bytes, back: bool, hexadecimal: bool = False) -> str:
    """ASCII letters and digits of text permuted, each within its class."""
    classes = ["0123456789abcdef" if hexadecimal else "0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for c in text if c.isascii() and c.isalnum()]
    value, size = 0, 1
    for c, own in zip((c for c in text if c.isascii() and c.isalnum()), classes, strict=True):
        value, size = value * len(own) + own.index(c), size * len(own)
    shape = "".join(str(len(own)) + own[0] for own in classes).encode()
    value, out = f.permute(value, size, tweak + shape, back), []
    for own in reversed(classes):
        value, k = divmod(value, len(own))
        out.append(own[k])
    return refill(text, "".join(reversed(out)))


def email(m: str, f: Feistel, back: bool) -> str:
    local, _, domain = m.partition("@")
    first, dot, rest = domain.partition(".")
    found = f"{local}@{first}"
    new = spread(found.lower(), f, b"email", back)
    return "".join(c.upper() if old.isupper() else c for c, old in zip(new, found, strict=True)) + dot + rest


def ipv4(m: str, f: Feistel, back: bool) -> str | None:
    parts = m.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    v = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4", back)
    return ".".join(map(str, v.to_bytes(4, "big")))


def card(m: str, f: Feistel, back: bool) -> str | None:
    digits = re.sub(r"\D", "", m)
    if not 13 <= len(digits) <= 19 or luhn(digits):
        return None
    body = f.permute(int(digits[:-1]), 10 ** (len(digits) - 1), b"card%d" % len(digits), back)
    own = f"{body:0{len(digits) - 1}d}"
    return refill(m, own + str(-luhn(own + "0") % 10))


def iban(m: str, f: Feistel, back: bool) -> str | None:
    plain = m.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = spread(plain[4:], f, b"iban" + plain[:2].encode(), back)
    return refill(m, f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02d}{body}")


#: Areas that are in use: not 000, 666, or 900 and above.
AREAS = [a for a in range(1, 900) if a != 666]


def ssn(m: str, f: Feistel, back: bool) -> str | None:
    area, group, serial = map(int, m.split("-"))
    if area not in AREAS or not group or not serial:
        return None
    v = f.permute((AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, len(AREAS) * 99 * 9999, b"ssn", back)
    v, s = divmod(v, 9999)
    a, g = divmod(v, 99)
    return f"{AREAS[a]:03d}-{g + 1:02d}-{s + 1:04d}"


# Country codes of one and of two digits; all others have three.
ONE_DIGIT = frozenset("1 7".split())
TWO_DIGITS = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())


def phone(m: str, f: Feistel, back: bool) -> str | None:
    """Numbers with + keep their country code; those without are national ones of code 1."""
    shape = m.replace("(0)", "(\0)")  # the trunk's digit is no part of a number with its country's code
    digits = re.sub(r"\D", "", shape)
    code = "1" if m[0] != "+" else digits[: 1 if digits[:1] in ONE_DIGIT else 2 if digits[:2] in TWO_DIGITS else 3]
    rest = digits[len(code) :] if m[0] == "+" else digits
    if not 7 <= len(rest) <= 14:
        return None
    v = f.permute(int(rest), 10 ** len(rest), b"phone%s|%d" % (code.encode(), len(rest)), back)
    return refill(shape, (code if m[0] == "+" else "") + f"{v:0{len(rest)}d}").replace("\0", "0")


FIRST = date(1900, 1, 1)
DAYS = (date(2100, 1, 1) - FIRST).days


def kind_of(day: date) -> tuple[bool, bool]:
    """What decides how a day may be written: after the 12th, and a day or month of one digit."""
    return day.day > 12, min(day.day, day.month) < 10


@cache
def days_by_kind() -> dict[tuple[bool, bool], list[date]]:
    out: dict[tuple[bool, bool], list[date]] = {}
    for n in range(DAYS):
        day = FIRST + timedelta(n)
        out.setdefault(kind_of(day), []).append(day)
    return out


def moved(day: date, f: Feistel, back: bool) -> date:
    kind = kind_of(day)
    alike = days_by_kind()[kind]
    return alike[f.permute(bisect_left(alike, day), len(alike), b"date%d%d" % kind, back)]


# Fixed values.
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS) + ")"


def named_day(m: str, f: Feistel, back: bool) -> str | None:
    """Dates with a month's name before or behind the day; the name stays short or whole."""
    name, year = re.search("[A-Za-z]+", m)[0], re.search(r"\d{4}$", m)[0]
    number = re.search(r"\d+", m)[0]
    try:
        day = date(int(year), next(k for k, x in enumerate(MONTHS, 1) if x.startswith(name)), int(number))
    except ValueError:
        return None
    if not 0 <= (day - FIRST).days < DAYS:
        return None
    new = moved(day, f, back)
    month = MONTHS[new.month - 1]
    month = month[:3] if len(name) == 3 and name != "May" else month
    if len(name) == 3 and name == "May":  # short and whole at once: as its mark says
        month = month[:3] if "May." in m else month
    own = f"{new.day:02d}" if number[0] == "0" else str(new.day)
    parts = {name: month, number: own, year: f"{new.year}"}
    return re.sub(r"[A-Za-z]+|\d{4}$|\d+", lambda x: parts[x[0]], m)


def calendar(m: str, f: Feistel, back: bool) -> str | None:
    """Dates: year-month-day, day.month.year, month/day/year (day/month/year where only that is one)."""
    sep = re.search(r"[-./]", m).group()
    parts = m.split(sep)
    padded = all(len(p) > 1 for p in parts)
    n = list(map(int, parts))
    order = {"-": (0, 1, 2), ".": (2, 1, 0), "/": (2, 0, 1)}[sep]
    if sep == "/" and n[0] > 12:  # the day comes first
        order = (2, 1, 0)
    try:
        day = date(*(n[i] for i in order))
    except ValueError:
        return None
    if not 0 <= (day - FIRST).days < DAYS:
        return None
    day = moved(day, f, back)
    own = [0, 0, 0]
    for value, i in zip((day.year, day.month, day.day), order, strict=True):
        own[i] = value
    return sep.join((f"{x:02d}" if padded else str(x)) for x in own)


def secret(m: str, f: Feistel, back: bool) -> str | None:
    if m.lower() != m and m.upper() != m or m.isdigit() or m.isalpha():
        return None
    upper = m.upper() == m
    body = spread(m.lower(), f, b"secret", back, hexadecimal=True)
    return body.upper() if upper else body


#: In order of precedence at one place. A format's letters and digits must not go on beyond what is found.
KINDS: list[tuple[str, str, Callable[[str, Feistel, bool], str | None]]] = [
    ("secret", r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![0-9A-Za-z])", secret),
    ("iban", r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])", iban),
    ("ipv4", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)", ipv4),
    ("date", r"(?<![\w./-])(?:\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{4}|\d{1,2}/\d{1,2}/\d{4})(?:(?=T\d{2}:\d{2})|(?![\w/-]|\.\d))", calendar),
    ("named", rf"(?<![\w])(?:{MONTH}\.? \d{{1,2}}, \d{{4}}|\d{{1,2}}\.? {MONTH}\.? \d{{4}})(?!\w)", named_day),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", ssn),
    ("card", r"(?<![\w.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w|-\d)", card),
    ("phone", r"(?<![\w])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)", phone),
]
NUMBERS = re.compile("|".join(f"(?P<{name}>{re.sub(r'\\([12])', lambda m: f'(?P=c{m[1]})', re.sub(r'\(\[ -\]\)', lambda m, n=iter('12'): f'(?P<c{next(n)}>[ -])', pattern))})" for name, pattern, _ in KINDS))
EMAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
OF = {name: f for name, _, f in KINDS}
HINT = re.compile(rb"[0-9@]")
#: Where a number or an IBAN may begin.
NEAR = re.compile(rf"(?:\+|\(|[A-Z]{{2}})?\d|(?<![0-9A-Za-z])[a-fA-F]+\d|(?<!\w){MONTH}\.? \d")


def pseudonyms(text: str, f: Feistel, back: bool = False) -> tuple[str, int]:
    """The text with its values replaced, and how many."""
    found = []
    for at in re.finditer("@", text):  # from each @ to both sides: no search from every letter
        left = LOCAL.search(text[max(0, at.start() - 65) : at.start()])
        if left and left.group() and (m := EMAIL.match(text, at.start() - len(left.group()))) and (not found or m.start() >= found[-1][1]):
            found.append((m.start(), m.end(), email(m.group(), f, back)))
    taken = [(a, b) for a, b, _ in found]
    at = 0
    while near := NEAR.search(text, at):
        m = NUMBERS.match(text, near.start()) or NUMBERS.match(text, near.end() - 1)
        new = OF[m.lastgroup if m.lastgroup in OF else next(k for k in OF if m[k])](m.group(), f, back) if m else None
        if new is None:
            at = near.end()
        else:
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), new))
            at = m.end()
    if not found:
        return text, 0
    out, last = [], 0
    for a, b, new in sorted(found):
        out += [text[last:a], new]
        last = b
    return "".join([*out, text[last:]]), len(found)


def pseudonymise(df: DataFrame, key: bytes, text_col: str = "text", keep: list[str] | None = None, count_out: str = "n_pseudonyms", back: bool = False) -> DataFrame:
    """keep (default: all columns of df, in their order) with the text replaced, and the number of replacements."""
    if not key:
        raise ValueError("pseudonyms need a key")

    def start():
        f = Feistel(key)

        def run(batch: pa.RecordBatch) -> list:
            column = batch.column(text_col)
            new, count = [], []
            for raw in Texts(column):
                if HINT.search(raw):
                    text, n = pseudonyms(raw.decode("utf-8", "replace"), f, back)
                else:
                    text, n = None, 0
                new.append(text if n else None)
                count.append(n)
            return [pc.coalesce(pa.array(new, column.type), column), pa.array(count, pa.int64())]

        return run

    keep = df.columns if keep is None else keep
    done = annotate(df, [StructField(text_col, StringType()), StructField(count_out, LongType())], start, [text_col], keep, text_col)
    return done.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col, count_out])])


def reveal(df: DataFrame, key: bytes, text_col: str = "text") -> DataFrame:
    """Undoes pseudonymise with the same key, for values whose pseudonyms stand apart as the values did."""
    return pseudonymise(df, key, text_col, back=True)
