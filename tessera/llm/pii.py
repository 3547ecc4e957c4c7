"""Format-preserving pseudonyms for private values.

A value is found by a pattern, validated (check digits, octets, calendar), turned
into a number within its format's range, and permuted there by a keyed Feistel
network with cycle walking. The permutation is conjugated with a step of one, so
that it has no fixed point: no value stands for itself. Equal values, however they
are punctuated, get equal pseudonyms in every document. Check digits are made
valid again. Values and their ranges:

card     13 to 19 digits that begin and are as many as an issuer's, with a valid Luhn sum; the first digit stays
iban     valid remainder modulo 97; country and letters' places stay
ssn      three groups that are assigned at all
phone    a + and 8 to 15 digits, or a ten-digit North American number; the country code's first digits, brackets and a 555 exchange stay
ip       four octets, or an address of eight groups of hexadecimal digits, some of them left out
date     a day from 1900 to 2099 as year-month-day, or day and month before the year
email    letters and digits before the @; the domain stays
secret   32 or more hexadecimal digits of either case, three dotted parts of which the first begins as an encoded brace,
         or what is assigned to a key, token, secret or password

Edge cases: a null text stays null and an empty one empty; whole texts are scanned;
a value inside a longer word or number is left alone;
of a run of groups that holds more than a value, the first groups that are valid are the value; where two values overlap, the
kind named first in ``KINDS`` holds; repeated rows give repeated results; an empty
table gives no rows; a column named ``private`` in the input is replaced.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from bisect import bisect, insort
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package

ROUNDS = 8
#: Characters of a secret permuted together; longer ones go piece by piece.
PIECE = 200
KINDS = ("email", "secret", "iban", "date", "ssn", "phone", "card", "ip")
FOUND = "text string, private array<struct<kind: string, start: int, end: int>>"

_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
_FIRST, _DAYS = datetime.date(1900, 1, 1).toordinal(), 73049  # days from 1900 to 2099

_AT = re.compile(r"@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\Z")
_PATTERNS = {
    "secret": re.compile(
        r"(?<![0-9A-Za-z])(?=[A-Fa-f]*+[0-9])(?=[0-9]*+[A-Fa-f])[0-9A-Fa-f]{32,}+(?![0-9A-Za-z])"
        r"|(?<![0-9A-Za-z_.-])eyJ[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+\.[0-9A-Za-z_-]{8,}+"
        r"|\b(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)\b[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?(?=[0-9A-Za-z_+/=.-]{8})([0-9A-Za-z_+/=-]++(?:\.[0-9A-Za-z_+/=-]++)*+)"
    ),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"),
    "date": re.compile(r"(?<![0-9./-])(?:([0-9]{4})-([0-9]{2})-([0-9]{2})|([0-9]{1,2})([/.])([0-9]{1,2})\5([0-9]{4}))(?![0-9/-]|\.[0-9])"),
    "ssn": re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])"),
    "phone": re.compile(r"(?<![0-9A-Za-z])\+[0-9](?:[ .()-]{0,2}[0-9]){7,14}(?![0-9])|(?<![0-9A-Za-z.+-])\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[.-][0-9]{4}(?![0-9])"),
    "card": re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])"),
    "ip": re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z]|\.[0-9])|(?<![0-9A-Za-z:.])(?:(?:[0-9A-Fa-f]{1,4}:){2,7}:?|::|[0-9A-Fa-f]{1,4}::)(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])"),
}

#: Characters of an IBAN by country.
IBAN_LENGTHS = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 TN24 TR26 UA29 VA22 VG24 XK20".split()}


#: First digits of card numbers, from and to, and how many digits they may have.
CARD_RANGES = (("1", "1", {15}), ("2221", "2720", {16}), ("300", "305", {14}), ("34", "34", {15}), ("35", "35", {16, 17, 18, 19}), ("36", "36", {14}), ("37", "37", {15}), ("38", "39", {14}), ("4", "4", {13, 16, 19}), ("50", "50", {13, 14, 15, 16, 17, 18, 19}), ("51", "55", {16}), ("56", "69", {13, 14, 15, 16, 17, 18, 19}))


def _issued(digits: str) -> bool:
    return any(a <= digits[: len(a)] <= b and len(digits) in sizes for a, b, sizes in CARD_RANGES)


def _likely_length(kind: str, plain: str) -> int:
    """Letters and digits of the value that ``plain`` begins with, 0 if that is open."""
    if kind == "iban":
        return IBAN_LENGTHS.get(plain[:2], 0)
    if kind == "phone":
        return 11 if plain[0] == "1" else 0
    return 15 if plain[:2] in ("34", "37") else 16 if plain[0] in "2456" else 0


class Feistel:
    """A keyed permutation of ``range(n)`` without fixed points, for each n from 2 and each label."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, label: str, k: int, half: int, value: int) -> int:
        data = f"{label}:{k}:{half}:{value}".encode()
        size = (half + 7) // 8
        out = b"".join(hashlib.blake2b(data + bytes([i]), key=self.key).digest() for i in range(-(-size // 64)))
        return int.from_bytes(out[:size], "big") & ((1 << half) - 1)

    def _walk(self, label: str, n: int, x: int, rounds: range, back: bool) -> int:
        half = max(1, ((n - 1).bit_length() + 1) // 2)
        low = (1 << half) - 1
        while True:
            left, right = x >> half, x & low
            for k in rounds:
                if back:
                    left, right = right ^ self._round(label, k, half, left), left
                else:
                    left, right = right, left ^ self._round(label, k, half, right)
            x = left << half | right
            if x < n:
                return x

    def permute(self, label: str, n: int, x: int) -> int:
        return self._walk(label, n, x, range(ROUNDS), back=False)

    def invert(self, label: str, n: int, x: int) -> int:
        return self._walk(label, n, x, range(ROUNDS - 1, -1, -1), back=True)

    def stand_in(self, label: str, n: int, x: int) -> int:
        """Another number than x, different for different x."""
        return x if n < 2 else self.invert(label, n, (self.permute(label, n, x) + 1) % n)


def luhn_digit(payload: str) -> str:
    """The digit that makes ``payload`` valid."""
    total = sum(d if k % 2 else (2 * d - 9 * (d > 4)) for k, d in enumerate(map(int, reversed(payload))))
    return str(-total % 10)


def _assignable(local: str) -> bool:
    """Whether ten digits are a North American number."""
    return len(local) == 10 and local[0] > "1" and local[3] > "1"


def iban_digits(country: str, rest: str) -> str:
    """The two check digits."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in rest + country + '00')) % 97:02d}"


def _spell(permute: Feistel, label: str, text: str, *classes: str) -> str:
    """``text`` with its characters permuted within classes, its ASCII letters' and digits' if none are given, the rest in place."""
    sets = [next((s for s in classes or (_DIGITS, _LOWER, _UPPER) if c in s), "") for c in text]
    n, x = 1, 0
    for c, s in zip(text, sets, strict=True):
        if s:
            n, x = n * len(s), x * len(s) + s.index(c)
    x = permute.stand_in(f"{label}{''.join(str(len(s)) + ',' if s else c for c, s in zip(text, sets, strict=True))}", n, x)
    out = []
    for c, s in zip(reversed(text), reversed(sets), strict=True):
        if s:
            x, k = divmod(x, len(s))
            c = s[k]
        out.append(c)
    return "".join(reversed(out))


def _dress(pattern: str, digits: str) -> str:
    """``digits`` in the places of ``pattern``'s letters and digits."""
    rest = iter(digits)
    return "".join(next(rest) if c.isascii() and c.isalnum() else c for c in pattern)


class Pseudonyms:
    """Finds private values in a text and replaces them."""

    def __init__(self, key: str) -> None:
        self.permute = Feistel(hashlib.blake2b(key.encode(), digest_size=32).digest())
        self.replace = lru_cache(maxsize=100_000)(self._replace)

    def _replace(self, kind: str, text: str) -> str | None:
        """The pseudonym of a value, or None if it isn't valid."""
        return getattr(self, f"_{kind}")(text)

    def _email(self, local: str) -> str | None:
        return _spell(self.permute, "email", local) if re.search(r"[A-Za-z0-9]", local) else None

    def _secret(self, value: str) -> str | None:
        pieces = [value[k : k + PIECE] for k in range(0, len(value), PIECE)]
        if re.fullmatch(r"[0-9A-Fa-f]{32,}", value):
            if value in (value.lower(), value.upper()):  # one secret in either case
                found = "".join(_spell(self.permute, "hex", p.lower(), _HEX) for p in pieces)
                return found if value == value.lower() else found.upper()
            return "".join(_spell(self.permute, "hex", p, _HEX + "ABCDEF") for p in pieces)
        return "".join(_spell(self.permute, "secret", p) for p in pieces) if re.search(r"[0-9]", value) and re.search(r"[A-Za-z]", value) else None

    def _iban(self, value: str) -> str | None:
        plain = value.replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_digits(plain[:2], plain[4:]) != plain[2:4]:
            return None
        rest = _spell(self.permute, f"iban{plain[:2]}", plain[4:])
        return _dress(value, plain[:2] + iban_digits(plain[:2], rest) + rest)

    def _date(self, value: str) -> str | None:
        m = _PATTERNS["date"].fullmatch(value)
        if m[1]:
            parts, shape = (m[1], m[2], m[3]), "{0:04d}-{1:02d}-{2:02d}"
        else:
            swap = int(m[6]) > 12 >= int(m[4])
            parts = (m[7], m[4], m[6]) if swap else (m[7], m[6], m[4])
            wide = "02d" if len(m[4]) == 2 and len(m[6]) == 2 else "d"
            shape = f"{{1:{wide}}}{m[5]}{{2:{wide}}}{m[5]}{{0}}" if swap else f"{{2:{wide}}}{m[5]}{{1:{wide}}}{m[5]}{{0}}"
        try:
            day = datetime.date(*map(int, parts)).toordinal() - _FIRST
        except ValueError:
            return None
        if not 0 <= day < _DAYS:
            return None
        new = datetime.date.fromordinal(_FIRST + self.permute.stand_in("date", _DAYS, day))
        return shape.format(new.year, new.month, new.day)

    def _ssn(self, value: str) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.permute.stand_in("ssn", 898 * 99 * 9999, x), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, value: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", value)
        american = value[0] != "+" or digits[0] == "1" and len(digits) == 11
        if american and _assignable(digits[-10:]):
            local = digits[-10:]
            exchange = local[3:6] if local[3:6] == "555" else ""
            x = (int(local[0]) - 2) * 100 + int(local[1:3])
            x = x * 10_000 + int(local[6:]) if exchange else (x * 800 + int(local[3:6]) - 200) * 10_000 + int(local[6:])
            x, line = divmod(self.permute.stand_in(f"phone{exchange}", 8_000_000 if exchange else 6_400_000_000, x), 10_000)
            x, middle = (x, int(exchange)) if exchange else (x // 800, x % 800 + 200)
            return _dress(value, digits[: len(digits) - 10] + f"{x + 200:03d}{middle:03d}{line:04d}")
        if value[0] != "+":
            return None
        if american:  # a number that can't be assigned: another such number
            new = digits
            while new == digits or _assignable(new[1:]):
                new = "1" + _spell(self.permute, "phone1", new[1:])
            return _dress(value, new)
        if not 8 <= len(digits) <= 15:
            return None
        return _dress(value, digits[:2] + _spell(self.permute, f"phone{digits[:2]}", digits[2:]))

    def _card(self, value: str) -> str | None:
        digits = re.sub(r"[^0-9]", "", value)
        if luhn_digit(digits[:-1]) != digits[-1] or not _issued(digits):
            return None
        payload = digits[:-1]
        while True:  # to the next number that is an issuer's
            payload = digits[0] + _spell(self.permute, f"card{digits[0]}", payload[1:])
            if _issued(payload + "0"):
                return _dress(value, payload + luhn_digit(payload))

    def _ip(self, value: str) -> str | None:
        if ":" in value:
            try:
                number = int(ipaddress.IPv6Address(value))
            except ValueError:
                return None
            if not re.search(r"[0-9]", value) or sum(map(bool, value.split(":"))) < 2:
                return None
            return str(ipaddress.IPv6Address(self.permute.stand_in("ipv6", 1 << 128, number)))
        octets = value.split(".")
        if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
            return None
        new = self.permute.stand_in("ip", 1 << 32, int.from_bytes(bytes(map(int, octets)), "big"))
        return ".".join(map(str, new.to_bytes(4, "big")))

    def _readings(self, kind: str, text: str, start: int, end: int) -> list[int]:
        """The ends of what a run over blanks may hold: the likely length first, then the longest, before ends within an address."""
        ends = [start + k for k in range(1, end - start) if text[start + k - 1].isalnum() and not text[start + k].isalnum()] + [end]
        if kind == "phone" and text[start] != "+":
            return [end]
        plain = re.sub(r"[^0-9A-Z]", "", text[start:end])
        likely = _likely_length(kind, plain)
        length = {e: sum(map(str.isalnum, text[start:e])) for e in ends}
        low, high = {"iban": (15, 34), "phone": (8, 15), "card": (13, 19)}[kind]
        ends = [e for e in ends if low <= length[e] <= high]
        inside = {e: any(m.start() < e < m.end() and self.replace("ip", m[0]) for m in _PATTERNS["ip"].finditer(text, start, end + 15)) for e in ends} if kind == "phone" else {}
        return sorted(ends, key=lambda e: (inside.get(e, False), length[e] != likely, -e))

    def find(self, text: str) -> list[tuple[int, int, str, str]]:
        """Start, end, kind and pseudonym of each value, in order."""
        taken: list[tuple[int, int, str, str]] = []

        def take(kind: str, start: int, end: int) -> bool:
            at = bisect(taken, (start, end))
            free = (not at or taken[at - 1][1] <= start) and (at == len(taken) or taken[at][0] >= end)
            if free and (new := self.replace(kind, text[start:end])) is not None:
                insort(taken, (start, end, kind, new))
                return True
            return False

        for m in _AT.finditer(text):
            if local := _LOCAL.search(text, max(0, m.start() - 64), m.start()):
                take("email", local.start(), m.start())
        for kind in KINDS[1:]:
            if kind in ("iban", "phone", "card"):
                at = 0
                while m := _PATTERNS[kind].search(text, at):
                    at = next((e for e in self._readings(kind, text, *m.span()) if take(kind, m.start(), e)), m.start() + 1)
                continue
            for m in _PATTERNS[kind].finditer(text):
                take(kind, *m.span(1 if kind == "secret" and m[1] else 0))
        return taken

    def scrub(self, text: str | None) -> tuple[str | None, list[tuple[str, int, int]]]:
        """The text with pseudonyms; kind, start and end of each in it."""
        if not text or not re.search(r"[0-9@=:]", text):
            return text, []
        out, spans, at, size = [], [], 0, 0
        for start, end, kind, new in self.find(text):
            out += [text[at:start], new]
            size += start - at + len(new)
            spans.append((kind, size - len(new), size))
            at = end
        return "".join([*out, text[at:]]), spans


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """``docs`` with private values in the text replaced, and ``private``: kind, start and end of each in the new text."""

    ship_package(docs.sparkSession)

    @F.pandas_udf(FOUND)
    def scrub(texts: pd.Series) -> pd.DataFrame:
        work = Pseudonyms(key)
        done = [work.scrub(t if isinstance(t, str) else None) for t in texts]
        return pd.DataFrame({"text": pd.Series([t for t, _ in done], dtype=object), "private": [[dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans] for _, spans in done]})

    own = [c for c in docs.columns if c != "private"]
    found = docs.select(*own, scrub(F.col(text_col).cast("string")).alias("__pii_found"))
    return found.select(*(F.col("__pii_found.text").alias(c) if c == text_col else F.col(c) for c in own), F.col("__pii_found.private").alias("private"))
