"""Personal data: format-preserving pseudonyms by a keyed Feistel permutation."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

ROUNDS = 10
KINDS = ("email", "card", "iban", "ssn", "phone", "ip", "date")
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0 .. n - 1: a Feistel network over two halves, walked until it lands inside."""

    def __init__(self, key: bytes, tweak: str, n: int):
        self.n = n
        self.a = max(2, math.isqrt(max(n - 1, 1)) + 1)
        self.b = max(2, -(-n // self.a))
        self.key, self.tweak = hashlib.blake2b(key, digest_size=32).digest(), tweak.encode()

    def _round(self, k: int, half: int, size: int) -> int:
        data = struct.pack(">H", k) + half.to_bytes(max(1, (half.bit_length() + 7) // 8), "big") + b"|" + self.tweak
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=32).digest(), "big") % size

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                right = (right + sign * self._round(k, left, self.b)) % self.b
            else:
                left = (left + sign * self._round(k, right, self.a)) % self.a
        return left * self.b + right

    def map(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        while (x := self._once(x, back)) >= self.n:
            pass
        return x


def luhn(digits: str) -> int:
    """The check digit that follows `digits`."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(shape: str, digits: str) -> str:
    """`shape` with its digits replaced in order."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _iban_check(country: str, account: str) -> str:
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


class Pseudonyms:
    """Finds personal data and permutes each value within its format.

    Cards keep length, separators, first digit and a valid Luhn digit; IBANs keep country,
    classes of characters and a valid checksum; social security numbers stay in
    the ranges that such numbers use; phone numbers and addresses of hosts in use (area and exchange from 200,
    unicast) stay so, and all others of the format stay among the others; those of other countries keep their country's digits; dates stay real dates of their notation, with one permutation for
    all notations; e-mail addresses keep their domain and each character's class. Values
    that fail validation are left alone. One key gives one pseudonym for a value everywhere.
    """

    PATTERN = re.compile(
        r"(?P<email>(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,})"
        r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
        r"|(?P<date>(?<![\w.-])(?:\d{4}-\d{2}-\d{2}(?=T\d{2}:?\d{2})|(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w-])))"  # also the day of a timestamp
        r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
        r"|(?P<ip>(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d))"
        r"|(?P<card>(?<![\w-])(?:\d{13,19}|\d{4}([ -])\d{4}\7\d{4}\7\d{4}(?:\7\d{3})?|\d{4}([ -])\d{6}\8\d{5})(?!\w))"
        r"|(?P<phone>(?<![\w+])(?:(?:\+1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+(?!1[ .(-])\d{1,3}(?:[ .-]\(?\d{1,8}\)?){2,5})(?!\w))"
    )
    NEED = re.compile(r"[0-9@]")

    def __init__(self, key: bytes):
        self.key = key
        self.map = lru_cache(100_000)(self._map)
        self.network = lru_cache(1000)(lambda kind, n: Feistel(key, kind, n))

    def permuted(self, kind: str, x: int, n: int, back: bool) -> int:
        return self.network(f"{kind}:{n}", n).map(x, back)

    def _map(self, kind: str, value: str, back: bool = False) -> str | None:
        return getattr(self, f"_{kind}")(value, back)

    def _card(self, value: str, back: bool) -> str | None:
        d = re.sub(r"\D", "", value)
        if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
            return None
        k = len(d) - 2
        body = d[0] + f"{self.permuted('card' + d[0], int(d[1:-1]), 10**k, back):0{k}d}"
        return _refill(value, body + str(luhn(body)))

    def _iban(self, value: str, back: bool) -> str | None:
        for end in range(len(value), 14, -1):  # capitals that follow may look like more of it
            plain = value[:end].replace(" ", "")
            country, account = plain[:2], plain[4:]
            if 15 <= len(plain) <= 34 and value[end - 1] != " " and value[end : end + 1] in ("", " ") and _iban_check(country, account) == plain[2:4]:
                new = self._by_class("iban" + country, account, back)
                out = iter(country + _iban_check(country, new) + new)
                return "".join(" " if c == " " else next(out) for c in value[:end]) + value[end:]
        return None

    def _ssn(self, value: str, back: bool) -> str | None:
        area, group, serial = map(int, value.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        at = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        rest, serial = divmod(self.permuted("ssn", at, 898 * 99 * 9999, back), 9999)
        area, group = divmod(rest, 99)
        area += 1 + (area + 1 >= 666)
        return f"{area:03d}-{group + 1:02d}-{serial + 1:04d}"

    def _phone(self, value: str, back: bool) -> str | None:
        digits = re.sub(r"\D", "", value)
        if value[0] == "+" and not re.match(r"\+1[ .(-]|\+1\d{3}[ .-]", value):  # other countries: all digits after the country's
            country = re.match(r"\d+", value[1:]).group()
            k = len(digits) - len(country)
            if not 8 <= len(digits) <= 15 or k < 6:
                return None
            return _refill(value, country + f"{self.permuted('phone' + country, int(digits[len(country) :]), 10**k, back):0{k}d}")
        d = digits[-10:]
        if d[0] in "01" or d[3] in "01":  # written like a phone number, outside the ranges in use
            area, exchange = int(d[:3]), int(d[3:6])
            x = area * 1000 + exchange if area < 200 else 200_000 + (area - 200) * 200 + exchange
            x, line = divmod(self.permuted("phone other", x * 10_000 + int(d[6:]), 360_000 * 10_000, back), 10_000)
            area, exchange = divmod(x, 1000) if x < 200_000 else divmod(x - 200_000 + 200 * 200, 200)
            return _refill(value, digits[:-10] + f"{area:03d}{exchange:03d}{line:04d}")
        x = ((int(d[:3]) - 200) * 800 + int(d[3:6]) - 200) * 10_000 + int(d[6:])
        x = self.permuted("phone", x, 800 * 800 * 10_000, back)
        x, line = divmod(x, 10_000)
        area, exchange = divmod(x, 800)
        return _refill(value, digits[:-10] + f"{area + 200}{exchange + 200}{line:04d}")

    def _ip(self, value: str, back: bool) -> str | None:
        parts = value.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        if not 1 <= x >> 24 <= 223:  # first numbers 0 and 224 to 255
            x = self.permuted("ip other", x if x < 1 << 24 else x - (223 << 24), 33 << 24, back)
            return ".".join(map(str, (x if x < 1 << 24 else x + (223 << 24)).to_bytes(4, "big")))
        x -= 1 << 24
        return ".".join(map(str, (self.permuted("ip", x, 223 << 24, back) + (1 << 24)).to_bytes(4, "big")))

    def _date(self, value: str, back: bool) -> str | None:
        form = "%Y-%m-%d" if value[4] == "-" else "%d/%m/%Y" if value[2] == "/" else "%d.%m.%Y"
        if not value.isascii():
            return None
        try:
            day = dt.datetime.strptime(value, form).date().toordinal()
        except ValueError:
            return None
        if not FIRST_DAY <= day <= LAST_DAY:
            return None
        new = dt.date.fromordinal(self.permuted("date", day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, back) + FIRST_DAY)
        return f"{new.year:04d}-{new.month:02d}-{new.day:02d}" if form[1] == "Y" else f"{new.day:02d}{value[2]}{new.month:02d}{value[2]}{new.year:04d}"

    def _email(self, value: str, back: bool) -> str | None:
        local, domain = value.rsplit("@", 1)
        return f"{self._by_class('email' + domain.lower(), local, back)}@{domain}"

    def _by_class(self, kind: str, value: str, back: bool) -> str:
        """Permutes a value among those with the same class of character at each place."""
        sets = [("0123456789" if c.isdigit() else "abcdefghijklmnopqrstuvwxyz" if c.islower() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ" if c.isupper() else c) for c in value]
        x = n = 0
        n = 1
        for c, s in zip(value, sets, strict=True):
            x, n = x * len(s) + s.index(c), n * len(s)
        x = self.permuted(kind + re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", value))), x, n, back)
        out = []
        for s in reversed(sets):
            x, r = divmod(x, len(s))
            out.append(s[r])
        return "".join(reversed(out))

    def replace(self, text: str, back: bool = False) -> tuple[str, list[tuple[str, int, str]]]:
        """The text with pseudonyms, and (kind, start in the text as it was, pseudonym) of each."""
        found: list[tuple[str, int, str]] = []
        if not self.NEED.search(text):
            return text, found

        def one(m: re.Match) -> str:
            value = m.group()
            if not value.isascii():  # digits of other scripts
                return value
            new = self.map(m.lastgroup, value, back)
            if new is None:
                return value
            found.append((m.lastgroup, m.start(), new))
            return new

        return self.PATTERN.sub(one, text), found


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", back: bool = False, names: tuple[str, ...] = KINDS) -> DataFrame:
    """Replaces personal data in `text` and adds n_<kind> counts and the array `pseudonyms` (kind, start, value).

    Runs in Arrow batches without a shuffle; a worker keeps a bounded cache of values. Equal values
    have equal pseudonyms in all documents, different values different ones. With `back` the
    permutation is undone, given the same key. Null texts stay null and count 0; empty texts stay empty. Rows may
    repeat; an empty table gives no rows; other columns stay, but those named as the new ones.
    """
    new = [*(f"n_{k}" for k in names), "pseudonyms"]
    rows = docs.drop(*new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Pseudonyms(key)
        item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("value", pa.string())])
        for b in batches:
            texts, found = [], []
            for t in b.column(text):
                value = t.as_py()
                done = made.replace(value, back) if value else (value, [])
                texts.append(done[0])
                found.append(done[1])
            at = b.schema.get_field_index(text)
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            counts = [pa.array([sum(f[0] == k for f in fs) for fs in found], pa.int32()) for k in names]
            listed = pa.array([[{"kind": k, "start": s, "value": v} for k, s, v in fs] for fs in found], pa.list_(item))
            yield pa.RecordBatch.from_arrays([*b.columns, *counts, listed], [*b.schema.names, *new])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, fields + "".join(f", n_{k} int" for k in names) + ", pseudonyms array<struct<kind:string,start:int,value:string>>")
