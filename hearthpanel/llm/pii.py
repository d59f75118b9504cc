"""Personal data replaced by format-preserving pseudonyms.

E-mail addresses, phone numbers, payment card and long account numbers, IP addresses, IBANs, social
security numbers and dates are found by their form and validated (check digits, octets, calendar, number of
digits). A value, read without its separators, becomes the number of its place among all values of its kind, that
number is permuted by a keyed Feistel network, and the value it lands on is written with the separators found. Where
only part of the numbers are valid values, the network is applied until it lands on a valid one, which is again a
permutation. Equal values therefore get equal pseudonyms in all documents, however they are written, different
values different ones, and whoever has the key can undo them.

So that a day fits every way of writing it, days are permuted among those whose day lies in the same of 1 to 9,
10 to 12 and 13 to 31 and whose month in the same of 1 to 9 and 10 to 12. Country codes stay; three, three and four
digits without a country code are read as code 1, other national numbers (a 0, then ten or eleven digits in all) are
numbers of their own. Groups of zeros of an IPv6 address and its first group stay, as do mail domains; letters of a
mail name stay in their alphabet and case.

Null texts stay null, empty texts and texts without personal data stay as they are. Repeated rows get equal
results, an empty table an empty one; texts of any length are read whole.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthpanel.llm.common import numbered, pick, renamed

KEY = b"replace this key"
ROUNDS = 8
_CACHED = 1 << 16
_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """Keyed permutation of range(size), one for each tweak."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8 or 1
        data = tweak + bytes([i]) + half.to_bytes((half.bit_length() + 7) // 8 + 1, "little")
        return int.from_bytes(hashlib.blake2b(data, key=self.key, digest_size=min(64, size)).digest(), "little") & ((1 << bits) - 1)

    def once(self, x: int, bits: int, tweak: bytes, back: bool = False) -> int:
        low = bits // 2
        high = bits - low
        a, b = x >> low, x & ((1 << low) - 1)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if i % 2:
                b ^= self._round(tweak, i, a, low)
            else:
                a ^= self._round(tweak, i, b, high)
        return a << low | b

    def permute(
        self, x: int, size: int, tweak: bytes, allowed: Callable[[int], bool] | None = None, back: bool = False
    ) -> int:
        """Where ``x`` lands among range(size), or among the ``allowed`` numbers of it."""
        bits = max(2, (size - 1).bit_length())
        while True:
            x = self.once(x, bits, tweak, back)
            if x < size and (allowed is None or allowed(x)):
                return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def iban(text: str) -> bool:
    plain = text.replace(" ", "")
    return 15 <= len(plain) <= 34 and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


# Letters of mail names: Latin, Greek and Cyrillic with their marks. Scripts without spaces between words would
# make the words before an address part of its name.
_MAIL_RANGES = ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x300, 0x36F), (0x370, 0x52F))
_MAIL = "_" + "".join(f"{chr(a)}-{chr(b)}" for a, b in _MAIL_RANGES)
_ENDS = f"A-Za-z0-9{chr(0xC0)}-{chr(0x24F)}{chr(0x370)}-{chr(0x52F)}"

EMAIL = re.compile(
    rf"(?<![{_MAIL}.+-])([{_ENDS}][{_MAIL}.+-]{{0,63}})(@[{_ENDS}-]+(?:\.[{_ENDS}-]+)*\.[A-Za-z]{{2,24}})(?![{_MAIL}-])"
)
# Everything else begins with a digit, a plus sign, a bracket, two capitals with two digits or four hexadecimal digits.
NUMBER = re.compile(
    r"(?<![\w.+@/:-])(?:"
    r"(?P<phone>(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}|\d{3}[.-]\d{3}[.-]\d{4})"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})"
    r"|(?P<iso>\d{4}-\d{2}-\d{2})"
    r"|(?P<dmy>\d{1,2}[./]\d{1,2}[./]\d{4})"
    r"|(?P<ip>\d{1,3}(?:\.\d{1,3}){3})"
    r"|(?P<card>\d{4}(?:[ -]\d{4}){3}|\d{13,19})"
    r"|(?P<national>0\d{1,4}(?: \d{2,4}){2,4}|0\d{2,4}[ /]\d{6,8})"
    r"|(?P<iban>[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?))"
    r"|(?P<ip6>[0-9A-Fa-f]{4}:(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{1,4})"
    r")(?![\w@]|[./:-]\w)",
    re.ASCII,
)
# What any form but the last two holds: seven characters out of digits and the separators of all forms.
_MAY_HOLD = re.compile(r"\d[\d ()./-]{6}|[A-Z]{2}\d\d|[0-9A-Fa-f]{4}:", re.ASCII)
# Country calling codes of one and two digits (fixed values); all others have three.
_CODES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 "
    "90 91 92 93 94 95 98".split()
)


@lru_cache(maxsize=1 << 10)
def _class(c: str) -> str | None:
    """The letters or digits that may stand for ``c``; None for a character that stays."""
    if c.isascii():
        return next((k for k in ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c in k), None)
    kind, first = unicodedata.category(c), ord(c) & ~0x7F
    if kind not in ("Ll", "Lu") or not any(a <= ord(c) <= b for a, b in _MAIL_RANGES):
        return None
    inside = [o for o in range(first, first + 0x80) if any(a <= o <= b for a, b in _MAIL_RANGES)]
    return "".join(chr(o) for o in inside if unicodedata.category(chr(o)) == kind)


def _day_class(day: datetime.date) -> tuple[int, int]:
    return (day.day > 9) + (day.day > 12), int(day.month > 9)


@lru_cache(maxsize=1)
def _days() -> dict[tuple[int, int], list[int]]:
    """The days of each class in order."""
    found: dict[tuple[int, int], list[int]] = {}
    for day in range(_FIRST_DAY, _LAST_DAY + 1):
        found.setdefault(_day_class(datetime.date.fromordinal(day)), []).append(day)
    return found


def _country(digits: str) -> str:
    return next((digits[:n] for n in (1, 2) if digits[:n] in _CODES), digits[:3])


def _rewritten(text: str, plain: str) -> str:
    """``text`` with its letters and digits replaced, in order, by those of ``plain``."""
    new = iter(plain)
    return "".join(next(new) if c.isalnum() else c for c in text)


class Pseudonyms:
    def __init__(self, key: bytes):
        self.feistel = Feistel(key)
        self.known: dict[tuple[str, str], str | None] = {}

    def _letters(self, kind: str, text: str, valid: Callable[[str], bool] | None = None) -> str:
        """Letters and digits permuted within their classes; other characters stay. Values keep being
        valid, or invalid, under ``valid``."""
        sets = [_class(c) for c in text]
        size = number = 0
        size = 1
        for c, k in zip(text, sets):
            if k:
                number, size = number * len(k) + k.index(c), size * len(k)

        def written(x: int) -> str:
            out = list(text)
            for i in range(len(text) - 1, -1, -1):
                if k := sets[i]:
                    x, place = divmod(x, len(k))
                    out[i] = k[place]
            return "".join(out)

        if size < 2:
            return text
        shape = "".join("-" if k is None else k[0] for k in sets)
        allowed = (lambda x, is_valid=valid(text): valid(written(x)) == is_valid) if valid else None
        return written(self.feistel.permute(number, size, f"{kind}:{shape}".encode(), allowed))

    def _date(self, text: str) -> str | None:
        if "-" in text:
            return self._dated(text, "-", "ymd")
        sep = "." if "." in text else "/"
        if text.count(sep) != 2:
            return None
        # Month before day only where it cannot be day before month; such dates land on such dates.
        return self._dated(text, sep, "dmy") or self._dated(text, sep, "mdy")

    def _dated(self, text: str, sep: str, order: str) -> str | None:
        given = dict(zip(order, text.split(sep)))
        try:
            day = datetime.date(int(given["y"]), int(given["m"]), int(given["d"])).toordinal()
        except ValueError:
            return None
        if not _FIRST_DAY <= day <= _LAST_DAY:
            return None
        days = _days()[_day_class(datetime.date.fromordinal(day))]
        kind = ",".join(map(str, _day_class(datetime.date.fromordinal(day))))
        x = self.feistel.permute(bisect_left(days, day), len(days), f"date:{kind}".encode())
        new = datetime.date.fromordinal(days[x])
        # Days of one class have as many digits, so each part is as wide as it was.
        written = {"d": str(new.day).zfill(len(given["d"])), "m": str(new.month).zfill(len(given["m"])), "y": f"{new.year}"}
        return sep.join(written[k] for k in order)

    def _ip(self, text: str) -> str | None:
        octets = text.split(".")
        if any(int(o) > 255 or str(int(o)) != o for o in octets):
            return None
        x = self.feistel.permute(int.from_bytes(map(int, octets)), 1 << 32, b"ip")
        return ".".join(map(str, x.to_bytes(4)))

    def _ip6(self, text: str) -> str | None:
        try:
            address = ipaddress.IPv6Address(text)
        except ValueError:
            return None
        groups = [int(g, 16) for g in address.exploded.split(":")]
        # Addresses in use: global, local to a site, local to a link. Much else that has colons is no address.
        if not (groups[0] >> 13 == 1 or groups[0] >> 9 == 0x7E or groups[0] >> 6 == 0x3FA):
            return None
        at = [i for i in range(1, 8) if groups[i]]
        if not at:
            return None
        number = 0
        for i in at:
            number = number * 0xFFFF + groups[i] - 1
        tweak = f"ip6:{groups[0]:x}:{at}"
        number = self.feistel.permute(number, 0xFFFF ** len(at), tweak.encode())
        for i in reversed(at):
            number, rest = divmod(number, 0xFFFF)
            groups[i] = rest + 1
        if "::" not in text:
            padded = all(len(g) == 4 for g in text.split(":"))
            new = ":".join(f"{g:04x}" if padded else f"{g:x}" for g in groups)
        else:
            # The same groups as in the text are written out; those it leaves out are zeros and stay so.
            head, tail = [part.split(":") if part else [] for part in text.split("::")]
            new = ":".join(f"{g:x}" for g in groups[: len(head)]) + "::" + ":".join(f"{g:x}" for g in groups[8 - len(tail) :])
        return new.upper() if text.upper() == text and any(c.isalpha() for c in text) else new

    def _phone(self, text: str) -> str:
        digits = re.sub(r"\D", "", text)
        # Ten digits in the forms without a plus sign are a number of country code 1.
        code = _country(digits) if text.startswith("+") else ""
        rest = digits[len(code) :]
        return _rewritten(text, code + self._letters(f"phone+{code or 1}", rest))

    def value(self, kind: str, text: str) -> str | None:
        """Pseudonym of a value; None if it is not valid and stays."""
        if (kind, text) not in self.known:
            if len(self.known) >= _CACHED:
                self.known.clear()
            self.known[kind, text] = self._new(kind, text)
        return self.known[kind, text]

    def _new(self, kind: str, text: str) -> str | None:
        if kind in ("iso", "dmy"):
            return self._date(text)
        if kind == "ip":
            return self._ip(text)
        if kind == "ip6":
            return self._ip6(text)
        if kind == "phone":
            return self._phone(text)
        plain = re.sub("[ /-]", "", text)
        if kind == "card":
            return _rewritten(text, self._letters(kind, plain, luhn))
        if kind == "national":
            return _rewritten(text, self._letters(kind, plain)) if 10 <= len(plain) <= 11 else None
        if kind == "iban":
            country = plain[:2]
            valid = lambda t: iban(country + t)
            return _rewritten(text, country + self._letters(f"iban{country}", plain[2:], valid)) if iban(plain) else None
        return self._letters(kind, text)

    def text(self, text: str | None) -> tuple[str | None, int]:
        """The text with its pseudonyms, and how many values were replaced."""
        found = 0

        def number(m: re.Match) -> str:
            nonlocal found
            new = self.value(m.lastgroup, m[0])
            found += new is not None
            return m[0] if new is None else new

        def email(m: re.Match) -> str:
            nonlocal found
            found += 1
            return self.value("email" + m[2].lower(), m[1]) + m[2]

        if text and "@" in text:
            text = EMAIL.sub(email, text)
        if text and _MAY_HOLD.search(text):
            text = NUMBER.sub(number, text)
        return text, found


@lru_cache(maxsize=2)
def pseudonyms(key: bytes) -> Pseudonyms:
    return Pseudonyms(key)


def pseudonymised(text: Column, key: bytes = KEY) -> Column:
    """Struct of the ``text`` with pseudonyms and ``n_values``, the number of values replaced."""

    @F.arrow_udf("struct<text:string,n_values:bigint>")
    def run(texts: pa.Array) -> pa.Array:
        done = [pseudonyms(key).text(t) for t in texts.to_pylist()]
        columns = [pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())]
        return pa.StructArray.from_arrays(columns, ["text", "n_values"])

    return run(text)


def hide(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """``docs`` with pseudonyms in ``text``; all other columns as they are."""
    plain, names = numbered(docs)
    done = plain.withColumn("done", pseudonymised(F.col(f"c{names.index('text')}"), key))
    return renamed(done, names, text=F.col("done.text"))


def report(docs: DataFrame, key: bytes = KEY) -> DataFrame:
    """doc_id, text with pseudonyms and n_values of every document."""
    rows = pick(docs, "doc_id", "text").select("doc_id", pseudonymised(F.col("text"), key).alias("done"))
    return rows.select("doc_id", "done.text", "done.n_values")
