"""Format-preserving pseudonyms: validated numbers, dates, addresses and secrets, permuted under a key within their format.

A Feistel network over the integers below N (two halves of a square that covers N, walking on while a value lies outside) gives a
keyed permutation P. Values map by P^-1(P(x) + 1): a permutation again, without fixed points. Equal values get equal pseudonyms in
every document, different ones different, and a pseudonym still passes its format's validation.
"""
from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterable, Iterator
from hashlib import blake2b
from math import isqrt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countersign.llm.text import mapped

ROUNDS = 8
KEPT_VALUES = 100_000  # pseudonyms that one task remembers
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()
KINDS = ("email", "secret", "iban", "date", "ip", "phone", "ssn", "card")


class Permutation:
    """A keyed permutation of the integers below `size` that moves every one of them (if there are two or more)."""

    def __init__(self, key: bytes, label: str, size: int):
        self.key, self.label, self.size = key, label.encode(), size
        self.half = isqrt(max(size - 1, 0)) + 1

    def _round(self, i: int, x: int) -> int:
        seed = self.label + b"/%d/%d/%d" % (self.size, i, x)
        return int.from_bytes(blake2b(seed, key=self.key, digest_size=32).digest(), "big") % self.half

    def forward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.half)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right)) % self.half
            x = left * self.half + right
            if x < self.size:
                return x

    def backward(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.half)
            for i in reversed(range(ROUNDS)):
                left, right = (right - self._round(i, left)) % self.half, left
            x = left * self.half + right
            if x < self.size:
                return x

    def __call__(self, x: int) -> int:
        return x if self.size < 2 else self.backward((self.forward(x) + 1) % self.size)


DIGITS, SMALL, LARGE, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def by_class(text: str, key: bytes, label: str, alphabets: tuple[str, ...] = (DIGITS, SMALL, LARGE)) -> str:
    """Permute the characters that belong to an alphabet, each within its own; the others stay."""
    sets = [next((a for a in alphabets if c in a), "") for c in text]
    size = value = 0
    for c, a in zip(text, sets):
        if a:
            size, value = (size or 1) * len(a), value * len(a) + a.index(c)
    if not size:
        return text
    value = Permutation(key, label + "/" + "".join(str(alphabets.index(a)) if a else "-" for a in sets), size)(value)
    out = list(text)
    for i in reversed(range(len(text))):
        if sets[i]:
            value, at = divmod(value, len(sets[i]))
            out[i] = sets[i][at]
    return "".join(out)


def with_digits(text: str, digits: str) -> str:
    """Put digits in the places of the text's digits."""
    rest = iter(digits)
    return "".join(next(rest) if "0" <= c <= "9" else c for c in text)


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> int:
    doubled = (2 * int(c) for c in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10


def _email(m: re.Match, key: bytes) -> str | None:
    local, _, domain = m[0].rpartition("@")
    return f"{by_class(local, key, 'email/' + domain.lower())}@{domain}"


def _secret(m: re.Match, key: bytes) -> str | None:
    value = m["secret"]
    as_hex = len(value) >= 16 and all(c in HEX for c in value)
    new = by_class(value, key, "secret", (HEX,)) if as_hex else by_class(value, key, "secret")
    return m[0][: m.start("secret") - m.start()] + new + m[0][m.end("secret") - m.start() :]


def _iban(m: re.Match, key: bytes) -> str | None:
    flat = m[0].replace(" ", "")
    if not 15 <= len(flat) <= 34 or int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 != 1:
        return None
    body = by_class(flat[4:], key, "iban/" + flat[:2])
    check = 98 - int("".join(str(int(c, 36)) for c in body + flat[:2] + "00")) % 97
    rest = iter(f"{flat[:2]}{check:02d}{body}")
    return "".join(" " if c == " " else next(rest) for c in m[0])


def _date(m: re.Match, key: bytes) -> str | None:
    parts, marks = re.split(r"[-/.]", m[0]), re.findall(r"[-/.]", m[0])
    if marks[0] != marks[1]:
        return None
    for order in ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 1, 0), (2, 0, 1)):
        try:
            day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
        except ValueError:
            continue
        if FIRST_DAY <= day <= LAST_DAY:
            new = datetime.date.fromordinal(FIRST_DAY + Permutation(key, "date", LAST_DAY - FIRST_DAY + 1)(day - FIRST_DAY))
            values = dict(zip(order, (f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}")))
            return marks[0].join(values[i] for i in range(3))
    return None


def _ip(m: re.Match, key: bytes) -> str | None:
    octets = m[0].split(".")
    if any(int(o) > 255 or (len(o) > 1 and o[0] == "0") for o in octets):
        return None
    new = Permutation(key, "ip", 1 << 32)(int.from_bytes(bytes(map(int, octets)), "big"))
    return ".".join(map(str, new.to_bytes(4, "big")))


def _phone(m: re.Match, key: bytes) -> str | None:
    digits = digits_of(m[0])
    if not 7 <= len(digits) <= 15:
        return None
    lead = digits_of(m["country"] or "")
    body = digits[len(lead) :]
    new = Permutation(key, f"phone/{len(body)}", 10 ** len(body))(int(body))
    return with_digits(m[0], lead + f"{new:0{len(body)}d}")


def _valid_ssn(n: int) -> bool:
    area, group, serial = n // 1_000_000, n // 10_000 % 100, n % 10_000
    return 0 < area < 900 and area != 666 and group > 0 and serial > 0


def _ssn(m: re.Match, key: bytes) -> str | None:
    value = int(digits_of(m[0]))
    if not _valid_ssn(value):
        return None
    moved = Permutation(key, "ssn", 10**9)
    while not _valid_ssn(value := moved(value)):
        pass
    return with_digits(m[0], f"{value:09d}")


def _card(m: re.Match, key: bytes) -> str | None:
    digits = digits_of(m[0])
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn(digits):
        return None
    size = len(digits) - 2
    body = digits[0] + f"{Permutation(key, f'card/{digits[0]}', 10**size)(int(digits[1:-1])):0{size}d}"
    return with_digits(m[0], body + str(-luhn(body + "0") % 10))


FORMATS: dict[str, tuple[str, Callable[[re.Match, bytes], str | None]]] = {
    "email": (r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    "secret": (r"(?i:\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\b)[ \t]*[:=][ \t]*[\"']?(?P<secret>[A-Za-z0-9_+/\-]{8,})", _secret),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])", _iban),
    "date": (r"(?<![0-9./-])(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})(?![0-9/-]|\.[0-9])", _date),
    "ip": (r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])", _ip),
    "phone": (r"(?<![A-Za-z0-9+])(?:(?P<country>\+[0-9]{1,3})[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])", _phone),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", _ssn),
    "card": (r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])", _card),
}


#: Characters of an IBAN by country.
IBAN_LENGTHS = {c: n for n, names in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH CR HR LI LV", 22: "BG BH DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}.items() for c in names.split()}


def _ends(text: str, start: int, allowed: str, marks: str, most: int) -> dict[int, int]:
    """Ends of values that start here, before anything but a letter or digit, by their number of characters without marks."""
    out, at, n = {}, start, 0
    while at < len(text) and n < most:
        if text[at] in allowed:
            n, at = n + 1, at + 1
            if not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()):
                out[n] = at
        elif at > start and text[at] in marks and text[at - 1] not in marks:
            at += 1
        else:
            break
    return out


def _starts(m: re.Match, marks: str) -> list[int]:
    return [m.start(), *(i + 1 for i in range(m.start(), m.end()) if m.string[i] in marks)]


def _card_places(m: re.Match) -> Iterator[tuple[int, int]]:
    """The issuer's usual length at any start, then the longest from each start on: neighbours such as dates and amounts may be digits, too."""
    text, starts = m.string, _starts(m, " -")
    ends = {s: _ends(text, s, DIGITS, " -", 19) for s in starts}
    for s in starts:
        usual = 15 if text[s : s + 2] in ("34", "37") else 14 if text[s : s + 2] in ("30", "36", "38") else 16
        if usual in ends[s]:
            yield s, ends[s][usual]
    for s in starts:
        yield from ((s, e) for n, e in sorted(ends[s].items(), reverse=True) if n >= 13)


def _iban_places(m: re.Match) -> Iterator[tuple[int, int]]:
    """From each start on the country's length, then the whole match, or for unknown countries every length."""
    for s in _starts(m, " "):
        ends = _ends(m.string, s, DIGITS + LARGE, " ", 34)
        length = IBAN_LENGTHS.get(m.string[s : s + 2])
        if length in ends:
            yield s, ends[length]
        if s == m.start():
            yield m.span()
        if length is None:
            yield from ((s, e) for n, e in sorted(ends.items(), reverse=True) if n >= 15)


def _phone_places(m: re.Match) -> Iterator[tuple[int, int]]:
    yield from ((m.start(), e) for e in range(m.end() - 1, m.start(), -1) if m.string[e] in " .-")


#: What may stand before the @ of an address, and what it begins with.
LOCAL_BEGIN = frozenset(DIGITS + LARGE + LARGE.lower())
LOCAL = LOCAL_BEGIN | frozenset("._%+-")


def _next_email(pattern: re.Pattern, text: str, start: int) -> re.Match | None:
    """As `pattern.search`, but from each @ backwards: a long run without one costs nothing, one before an @ is walked once."""
    at = text.find("@", start)
    while at >= 0:
        begin = at
        while begin > start and text[begin - 1] in LOCAL:
            begin -= 1
        while begin < at and text[begin] not in LOCAL_BEGIN:
            begin += 1
        if begin < at and (m := pattern.match(text, begin)):
            return m
        at = text.find("@", at + 1)
    return None


#: Where a value may lie that a match includes or overlaps; the first that passes its check counts.
PLACES = {"iban": _iban_places, "card": _card_places}


class Pseudonyms:
    """Replaces the validated values of texts under one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.kinds = [(k, re.compile(p), f) for k, (p, f) in FORMATS.items()]
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, text: str | None) -> tuple[str | None, list[int]]:
        """The text with pseudonyms, and how many values of each kind it had. Found places never overlap: earlier kinds come first."""
        counts = [0] * len(KINDS)
        if not text or not ("@" in text or any(d in text for d in DIGITS) or "=" in text or ":" in text):
            return text, counts
        taken: list[tuple[int, int, str]] = []
        late: list[re.Match] = []
        for at, (kind, pattern, fn) in enumerate(self.kinds):
            if kind == "email" and "@" not in text:
                continue
            free, end = [], 0
            search = _next_email if kind == "email" else re.Pattern.search
            while m := search(pattern, text, end):
                places = PLACES[kind](m) if kind in PLACES else (m.span(),)
                found = self._first(kind, pattern, fn, text, places, taken)
                end = m.end()
                if found:
                    free.append(found)
                    end = found[1]
                elif kind == "phone":
                    late.append(m)
            counts[at] = len(free)
            taken = sorted(taken + free)
        # Digits that follow a phone number may be a card's, so shorter phone numbers come last.
        at = KINDS.index("phone")
        _, pattern, fn = self.kinds[at]
        for m in late:
            if found := self._first("phone", pattern, fn, text, _phone_places(m), taken):
                counts[at] += 1
                taken = sorted([*taken, found])
        out, end = [], 0
        for a, b, new in taken:
            out += [text[end:a], new]
            end = b
        return "".join([*out, text[end:]]), counts

    def _first(self, kind: str, pattern: re.Pattern, fn: Callable[[re.Match, bytes], str | None], text: str, places: Iterable[tuple[int, int]], taken: list[tuple[int, int, str]]) -> tuple[int, int, str] | None:
        """The first place that is free and whose value passes its check, with the pseudonym."""
        for start, end in places:
            if any(a < end and start < b for a, b, _ in taken) or not (m := pattern.fullmatch(text, start, end)):
                continue
            if len(self.known) > KEPT_VALUES:
                self.known.clear()
            if (kind, m[0]) not in self.known:
                self.known[kind, m[0]] = fn(m, self.key)
            if (new := self.known[kind, m[0]]) is not None:
                return start, end, new
        return None


def pseudonymise(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row: `doc_id, text, n_found, n_<kind>...`, the text with every validated value replaced.

    Values that fail their check (Luhn, calendar, mod 97, octets, issued ranges) stay as they are, but values inside a failed match are sought. Null texts stay null, empty ones
    empty; null ids and repeated rows are rows like any other; no rows give none; other columns are not read.
    """

    def run(batches: Iterator[dict]) -> Iterator[dict]:
        names = Pseudonyms(key)
        for b in batches:
            rows = [names.of(t) for t in b["text"]]
            yield {"doc_id": b["doc_id"], "text": [t for t, _ in rows], "n_found": [sum(c) for _, c in rows], **{f"n_{k}": [c[i] for _, c in rows] for i, k in enumerate(KINDS)}}

    schema = "doc_id long, text string, n_found long, " + ", ".join(f"n_{k} long" for k in KINDS)
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)
