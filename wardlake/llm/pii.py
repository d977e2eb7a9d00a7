"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

Each finding is validated (calendar, check digit, ranges), mapped to its place
in the list of all values of its format, moved by a keyed Feistel permutation of
that list and written back in the same format: punctuation, case and length
stay. Equal values get equal pseudonyms in every document, different values
different ones, and the key holder can undo it.

NULL texts stay NULL, texts without findings are returned unchanged.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

ROUNDS = 8
DAY0, DAYS = datetime.date(1900, 1, 1).toordinal(), 73049
#: First bytes of public IPv4 addresses, and those of multicast and reserved ones; each kind stays among its own.
FIRST_BYTES = [b for b in range(1, 224) if b not in (10, 127)]
HIGH_BYTES = list(range(224, 256))
DIGITS, LOWER, HEX, ALNUM = "0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"

PATTERNS = {
    "email": r"[A-Za-z0-9._%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}",
    "secret": r"""\bAKIA[0-9A-Z]{16}\b|(?i:\b(?:password|passwd|secret|token|api_?key)\b)["']?\s*[=:]\s*["']?[A-Za-z0-9_\-]{8,}""",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]){11,30}\b",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "iso": r"(?<![\d\-])\d{4}-\d{2}-\d{2}(?![\d\-])",
    "dmy": r"(?<![\d./])\d{2}(?P<sep>[./])\d{2}(?P=sep)\d{4}(?![\d/])",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": "|".join(
        (
            r"(?<![\d\w])\+?(?:1[ .\-]?)?\([2-9]\d\d\)[ .\-]?[2-9]\d\d[ .\-]\d{4}(?!\d)",
            r"(?<![\d\w])(?:\+?1[ .\-])?[2-9]\d\d[ .\-][2-9]\d\d[ .\-]\d{4}(?!\d)",
            r"(?<![\d\w])\+1[ .\-]?\(\d{3}\)[ .\-]?\d{3}[ .\-]?\d{4}(?!\d)",
            r"(?<![\d\w])\+\d{1,3}[ .\-]?\(\d{1,4}\)(?:[ .\-]?\d{2,4}){1,4}(?!\d)",
            r"(?<![\d\w])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)",
        )
    ),
    "card": r"(?<![\d\w])\d(?:[ \-]?\d){12,18}(?![\d\w])",
}
FINDINGS = re.compile("|".join(f"(?P<{kind}>{p})" for kind, p in PATTERNS.items()))
ALONE = [(kind, re.compile(p)) for kind, p in PATTERNS.items()]
#: Kinds whose pattern may take in the word after the value.
GREEDY = {"iban", "phone", "card"}
#: Usual ways to write a card number; what follows is something else.
CARD = re.compile(r"\d{4}([ \-])\d{4}\1\d{4}\1\d{4}(?![\d\w])|\d{4}([ \-])\d{6}\2\d{5}(?![\d\w])")
#: Characters of an IBAN by country.
IBAN_LENGTHS = {
    country: int(x[:2])
    for x in (
        "15NO 16BE 18DKFIFOGLNLSD 19MKSI 20ATBAEEKZLTLUXK 21CHHRLILV 22BGBHCRDEGBGEIERSMEVA 23AEGIILIQTL 24ADCZESMDPKROSASESKTNVG 25LYPT "
        "26ISTR 27BIFRGRITMCMRSM 28ALAZBYCYDOGTHULBNIPLSV 29BREGPSQAUA 30JOKWMU 31MTSC 32LC"
    ).split()
    for country in re.findall("..", x[2:])
}
#: A text without any of these has no finding.
HINT = re.compile(r"[0-9@=:]")


def permute(x: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel rounds, walked until the value is in range."""
    if size < 2:
        return x
    half = ((size - 1).bit_length() + 1) // 2
    mask, width = (1 << half) - 1, (half + 7) // 8

    def f(r: int, v: int) -> int:
        h = hashlib.shake_256(key + bytes([r, len(tweak)]) + tweak + v.to_bytes(width, "big"))
        return int.from_bytes(h.digest(width), "big") & mask

    while True:
        left, right = x >> half, x & mask
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if back:
                left, right = right ^ f(r, left), left
            else:
                left, right = right, left ^ f(r, right)
        x = left << half | right
        if x < size:
            return x


def _mixed(values: list[int], bases: list[int], key: bytes, tweak: bytes, back: bool) -> list[int]:
    """Positions with a base of their own, permuted together as one number."""
    x, size = 0, 1
    for v, b in zip(values, bases, strict=True):
        x, size = x * b + v, size * b
    x = permute(x, size, key, tweak, back)
    out = []
    for b in reversed(bases):
        out.append(x % b)
        x //= b
    return out[::-1]


def _characters(text: str, alphabets: list[str | None], key: bytes, tweak: bytes, back: bool, case: bool = True) -> str:
    """The characters with an alphabet are permuted together; upper case stays upper case."""
    at = [i for i, a in enumerate(alphabets) if a]
    values = [alphabets[i].index(text[i].lower() if case else text[i]) for i in at]
    out = list(text)
    for i, v in zip(at, _mixed(values, [len(alphabets[i]) for i in at], key, tweak, back), strict=True):
        c = alphabets[i][v]
        out[i] = c.upper() if case and text[i].isupper() else c
    return "".join(out)


def _by_class(text: str) -> list[str | None]:
    return [DIGITS if "0" <= c <= "9" else LOWER if c.isascii() and c.isalpha() else None for c in text]


def luhn(digits: str) -> int:
    """Sum modulo 10 of a card number; 0 if its check digit is right."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10


def _refill(shape: str, characters: str) -> str:
    rest = iter(characters)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _date(y: int, m: int, d: int, key: bytes, back: bool) -> datetime.date | None:
    try:
        day = datetime.date(y, m, d).toordinal() - DAY0
    except ValueError:
        return None
    if not 0 <= day < DAYS:
        return None
    return datetime.date.fromordinal(DAY0 + permute(day, DAYS, key, b"date", back))


def _american(digits: str) -> bool:
    return len(digits) in (10, 11) and (len(digits) == 10 or digits[0] == "1") and digits[-10] in "23456789" and digits[-7] in "23456789"


def replacement(kind: str, found: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of one finding; None where it is not valid."""
    if kind == "email":
        head, dot, top = found.rpartition(".")
        return _characters(head, _by_class(head), key, b"email", back) + dot + top
    if kind == "secret":
        if found.startswith("AKIA"):
            return "AKIA" + _characters(found[4:], [DIGITS if c in DIGITS else LOWER for c in found[4:]], key, b"akia", back)
        start = re.search(r"[A-Za-z0-9_\-]+$", found).start()
        value = found[start:]
        hexadecimal = all(c in HEX for c in value)
        return found[:start] + _characters(value, [HEX] * len(value) if hexadecimal else _by_class(value), key, b"secret", back)
    if kind == "ip":
        parts = [int(p) for p in found.split(".")]
        own, tweak = (HIGH_BYTES, b"ip high") if parts[0] >= 224 else (FIRST_BYTES, b"ip")
        if parts[0] not in own or max(parts) > 255 or any(p != str(int(p)) for p in found.split(".")):
            return None
        moved = _mixed([own.index(parts[0]), *parts[1:]], [len(own), 256, 256, 256], key, tweak, back)
        return ".".join(map(str, [own[moved[0]], *moved[1:]]))
    if kind == "iso":
        day = _date(int(found[:4]), int(found[5:7]), int(found[8:]), key, back)
        return day.isoformat() if day else None
    if kind == "dmy":
        sep = "." if "." in found else "/"
        a, b, y = map(int, found.split(sep))
        if sep == "/" and a <= 12:  # with a slash the month comes first unless it cannot be one
            day = _date(y, a, b, key, back)
            return f"{day.month:02d}/{day.day:02d}/{day.year}" if day else None
        day = _date(y, b, a, key, back)
        while day and sep == "/" and day.day <= 12:  # stays readable in one way only
            day = _date(day.year, day.month, day.day, key, back)
        return f"{day.day:02d}{sep}{day.month:02d}{sep}{day.year}" if day else None
    digits = "".join(c for c in found if c.isalnum())
    if kind == "ssn":
        area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        areas = [a for a in range(1, 900) if a != 666]
        moved = _mixed([areas.index(area), group - 1, serial - 1], [898, 99, 9999], key, b"ssn", back)
        return f"{areas[moved[0]]:03d}-{moved[1] + 1:02d}-{moved[2] + 1:04d}"
    if kind == "phone":
        if _american(digits):
            own = digits[-10:]
            bases = [8, 10, 10, 8, 10, 10, 10, 10, 10, 10]
            moved = _mixed([int(c) - 10 + b for c, b in zip(own, bases, strict=True)], bases, key, b"phone", back)
            return _refill(found, digits[:-10] + "".join(str(v + 10 - b) for v, b in zip(moved, bases, strict=True)))
        if not 8 <= len(digits) <= 15:
            return None
        while True:  # stays outside the American form, which is moved in another way
            digits = digits[:2] + _characters(digits[2:], [DIGITS] * (len(digits) - 2), key, b"phone", back)
            if not _american(digits):
                return _refill(found, digits)
    if kind == "card":
        if not 13 <= len(digits) <= 19 or luhn(digits) or len(set(digits)) == 1:
            return None
        body = digits[0] + _characters(digits[1:-1], [DIGITS] * (len(digits) - 2), key, b"card", back)
        return _refill(found, body + str(-luhn(body + "0") % 10))
    if kind == "iban":
        def remainder(x: str) -> int:
            return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97

        if not 15 <= len(digits) <= 34 or remainder(digits) != 1:
            return None
        body = _characters(digits[4:], _by_class(digits[4:]), key, b"iban", back)
        return _refill(found, f"{digits[:2]}{98 - remainder(digits[:2] + '00' + body):02d}{body}")
    raise ValueError(kind)


@lru_cache(maxsize=100_000)
def _remembered(kind: str, found: str, key: bytes, back: bool) -> str | None:
    return replacement(kind, found, key, back)


def _usual_end(kind: str, text: str, start: int, end: int) -> int:
    """Where a value ends by its country's length or the usual groups of its digits; ``end`` if these say nothing."""
    if kind == "card":
        usual = CARD.match(text, start, end)
        # the pattern must not end inside a word
        return usual.end() if usual and (usual.end() == end or not text[usual.end()].isalnum()) else end
    left = IBAN_LENGTHS.get(text[start : start + 2], 0) if kind == "iban" else 0
    for i in range(start, end if left else start):
        left -= text[i].isalnum()
        if not left:
            return i + 1 if i + 1 == end or not text[i + 1].isalnum() else end
    return end


def _candidates(text: str, m: re.Match) -> Iterator[tuple[str, int]]:
    """(kind, end) of what may begin where ``m`` does: its usual end, the longest, shorter ones, then the other kinds."""
    start, first = m.start(), m.lastgroup if m.lastgroup != "sep" else "dmy"
    waiting = True
    for kind, pattern in ALONE:
        waiting = waiting and kind != first
        found = None if waiting else pattern.match(text, start)
        if not found:
            continue
        end = found.end()
        if kind not in GREEDY:
            yield kind, end
            continue
        usual = _usual_end(kind, text, start, end)
        yield kind, usual
        if usual != end:
            yield kind, end
        for i in range(end - 1, start, -1):
            if i != usual and text[i - 1].isalnum() and not text[i].isalnum():
                yield kind, i


def pseudonymise_text(text: str, key: bytes, back: bool = False) -> tuple[str, int]:
    """The text with pseudonyms, and how many values were replaced.

    Where a finding is not valid as a whole, its beginnings up to a word's end
    are tried, then the other kinds, and the search goes on after its first
    character. A pseudonym that would make valid what was refused before it is
    moved on until it does not, so that undoing meets the same values.
    """
    if not HINT.search(text):
        return text, 0
    n = done = at = 0
    out: list[str] = []
    refused: list[tuple[str, int, int]] = []
    while m := FINDINGS.search(text, at):
        start = m.start()
        at = start + 1
        refused = [r for r in refused if r[2] > start]
        for kind, end in _candidates(text, m):
            new = _remembered(kind, text[start:end], key, back)
            if new is None:
                refused.append((kind, start, end))
                continue
            while any(_remembered(k, (text[a:start] + new + text[end:b])[: b - a], key, back) is not None for k, a, b in refused):
                new = replacement(kind, new, key, back)
            out += [text[done:start], new]
            n += new != text[start:end]
            done = at = end
            break
    return "".join([*out, text[done:]]), n


def pseudonymised(text: Column, key: str, back: bool = False) -> Column:
    """struct(text, n_replaced) of a text column; ``back`` undoes it with the same key."""
    secret = key.encode()

    @F.arrow_udf("text string, n_replaced long")
    def work(texts: pa.Array) -> pa.Array:
        out, counts = [], []
        for t in texts.to_pylist():
            new, n = (None, 0) if t is None else pseudonymise_text(t, secret, back)
            out.append(new)
            counts.append(n)
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(counts, pa.int64())], ["text", "n_replaced"])

    return work(text)
