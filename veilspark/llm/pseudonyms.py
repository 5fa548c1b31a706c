"""Format-preserving pseudonyms: validated numbers and dates are permuted, under a key, within their own format.

Every kind of value is mapped to a number below the size of its format, permuted by a Feistel network with cycle
walking, and written back in the layout in which it stood.  Equal values get equal pseudonyms, whatever the document
and the layout, and with the key the permutation can be turned back.  One exception: where a pseudonym would complete
a longer or earlier valid number with what stands beside it, it is permuted on, so that it can be turned back.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from datetime import date
from functools import lru_cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: Days that dates are permuted among.
FIRST, LAST = date(1900, 1, 1), date(2099, 12, 31)


class Feistel:
    """A keyed permutation of the numbers below n, another one for each kind of value."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, kind: str, n: int, turn: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        head = f"{kind}|{n}|{turn}|".encode()
        out = b""
        while len(out) < size:
            out += blake2b(head + len(out).to_bytes(2, "big") + half.to_bytes(size, "big"), key=self.key, digest_size=64).digest()
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, n: int, kind: str, back: bool = False) -> int:
        if n < 2:
            return x
        bits = max(1, ((n - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:  # the network permutes 2**(2 * bits) numbers, fewer than 4 n; walk on until one is below n
            left, right = x >> bits, x & mask
            for turn in range(ROUNDS - 1, -1, -1) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(kind, n, turn, left, bits), left
                else:
                    left, right = right, left ^ self._round(kind, n, turn, right, bits)
            x = left << bits | right
            if x < n:
                return x


def luhn_digit(digits: str) -> str:
    """The digit that makes digits + it pass Luhn's check."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _refill(layout: str, symbols: str) -> str:
    """layout with its ASCII letters and digits replaced, one after the other."""
    it = iter(symbols)
    return "".join(next(it) if c.isascii() and c.isalnum() else c for c in layout)


def _digits(s: str) -> str:
    return "".join(c for c in s if c.isdigit())


def _by_class(f: Feistel, s: str, kind: str, back: bool) -> str:
    """Letters and digits of s permuted together, each within its class: a-z, A-Z or 0-9."""
    spans = [(97, 26) if c.islower() else (65, 26) if c.isupper() else (48, 10) for c in s]
    x = n = 0
    n = 1
    for c, (base, size) in zip(s, spans):
        x, n = x * size + ord(c) - base, n * size
    shape = "".join("a" if b == 97 else "A" if b == 65 else "0" for b, _ in spans)
    x = f.permute(x, n, f"{kind}|{shape}", back)
    out = []
    for base, size in reversed(spans):
        x, d = divmod(x, size)
        out.append(chr(base + d))
    return "".join(reversed(out))


def _card(f: Feistel, s: str, back: bool) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    n = 10 ** (len(d) - 1)
    while True:  # on past numbers of one digit, which are no cards
        x = str(f.permute(int(d[:-1]), n, "card", back)).zfill(len(d) - 1)
        d = x + luhn_digit(x)
        if len(set(d)) > 1:
            break
    return _refill(s, d)


# Calling codes of two digits, and beginnings of those of three; 1 and 7 are codes by themselves.
CODES_2 = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
CODES_3 = "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()


def calling_code(digits: str) -> str | None:
    """The country's part of an international number, whatever its layout; None if there is no such country."""
    if digits[0] in "17":
        return digits[0]
    return digits[:2] if digits[:2] in CODES_2 else digits[:3] if digits[:2] in CODES_3 else None


def _phone(f: Feistel, s: str, back: bool) -> str | None:
    d = _digits(s)
    code = calling_code(d)
    if code is None or len(d) > 15 or not 7 <= len(d) - len(code) <= 12:
        return None
    n = len(d) - len(code)
    return _refill(s, code + str(f.permute(int(d[len(code) :]), 10**n, f"phone{code}", back)).zfill(n))


def _address(f: Feistel, s: str, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    x = f.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


def _email(f: Feistel, s: str, back: bool) -> str:
    local, _, domain = s.rpartition("@")
    symbols = "".join(c for c in local if c.isalnum())
    return f"{_refill(local, _by_class(f, symbols, f'email@{domain.lower()}', back))}@{domain}"


def _ssn(f: Feistel, s: str, back: bool) -> str | None:
    area, group, serial = (int(p) for p in s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    areas = 898  # 001 to 899 without 666
    x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
    x, serial = divmod(f.permute(x, areas * 99 * 9999, "ssn", back), 9999)
    area, group = divmod(x, 99)
    area += 1
    return f"{area + (area >= 666):03d}-{group + 1:02d}-{serial + 1:04d}"


def _iban(f: Feistel, s: str, back: bool) -> str | None:
    d = "".join(c for c in s if c.isalnum())
    rest = lambda x: int("".join(str(int(c, 36)) for c in x)) % 97
    if not 15 <= len(d) <= 34 or rest(d[4:] + d[:4]) != 1:
        return None
    body = _by_class(f, d[4:], f"iban{d[:2]}", back)
    return _refill(s, f"{d[:2]}{98 - rest(body + d[:2] + '00'):02d}{body}")


def _secret(f: Feistel, s: str, back: bool) -> str | None:
    return _by_class(f, s, "secret", back) if any(c.isdigit() for c in s) else None


def _hex_secret(f: Feistel, s: str, back: bool) -> str | None:
    up = s == s.upper()
    x = f.permute(int(s, 16), 16 ** len(s), f"hex{len(s)}", back)
    out = f"{x:0{len(s)}x}"
    return out.upper() if up else out


def _date_class(day: date) -> tuple[int, int]:
    """Dates that any layout writes with the same digits, and that can be taken for another order alike."""
    return (day.day > 9) + (day.day > 12), int(day.month > 9)


@lru_cache(1)
def _dates() -> tuple[dict[tuple[int, int], list[int]], dict[int, int]]:
    """The days of each class, and each day's place in its class."""
    classes: dict[tuple[int, int], list[int]] = {}
    place: dict[int, int] = {}
    for x in range(FIRST.toordinal(), LAST.toordinal() + 1):
        own = classes.setdefault(_date_class(date.fromordinal(x)), [])
        place[x] = len(own)
        own.append(x)
    return classes, place


def _date(order: str) -> Callable[[Feistel, str, bool], str | None]:
    """order ymd, or dmy, which is read as mdy where that alone is a date.

    Days are permuted within their class, so that a pseudonym is written and read in the order of what it stands for.
    """

    def run(f: Feistel, s: str, back: bool) -> str | None:
        parts = re.split(r"([-./])", s)
        for names in ("ymd",) if order == "ymd" else ("dmy", "mdy"):
            at = {n: int(p) for n, p in zip(names, parts[::2])}
            try:
                day = date(at["y"], at["m"], at["d"])
            except ValueError:
                continue
            if not FIRST <= day <= LAST:
                return None
            classes, place = _dates()
            own = classes[_date_class(day)]
            day = date.fromordinal(own[f.permute(place[day.toordinal()], len(own), f"date{_date_class(day)}", back)])
            new = {"y": day.year, "m": day.month, "d": day.day}
            return parts[1].join(str(new[n]).zfill(len(p)) for n, p in zip(names, parts[::2]))
        return None

    return run


#: kind -> (what a text must hold, pattern, permutation); kinds named first win where matches overlap.
KINDS: dict[str, tuple[str, re.Pattern, Callable]] = {
    "email": ("@", re.compile(r"(?<![A-Za-z0-9._%+-])(?=[._%+-]*[A-Za-z0-9])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24}"), _email),
    "secret": ("", re.compile(r"(?<=(?<![A-Za-z0-9])AKIA)[0-9A-Z]{16}(?![A-Za-z0-9])"), _secret),
    "hex": ("", re.compile(r"(?i:(?<=password=)|(?<=passwd=)|(?<=token=)|(?<=secret=)|(?<=key=)|(?<=token = \")|(?<=secret = \")|(?<=key = \"))(?:[0-9a-f]{16,128}|[0-9A-F]{16,128})(?![A-Za-z0-9])"), _hex_secret),
    "iban": ("", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban),
    "date_ymd": ("", re.compile(r"(?<![0-9A-Za-z./-])[0-9]{4}([-./])[0-9]{1,2}\1[0-9]{1,2}(?![0-9/-])(?:(?![A-Za-z])|(?=[Tt][0-2][0-9]))(?!\.[0-9])"), _date("ymd")),
    "date_dmy": ("", re.compile(r"(?<![0-9A-Za-z./-])[0-9]{1,2}([-./])[0-9]{1,2}\1[0-9]{4}(?![0-9/-])(?:(?![A-Za-z])|(?=[Tt][0-2][0-9]))(?!\.[0-9])"), _date("dmy")),
    "ssn": ("", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"), _ssn),
    "ip": ("", re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9A-Za-z])(?!\.[0-9])"), _address),
    "phone": ("", re.compile(r"(?<![0-9A-Za-z])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"), _phone),
    "card": ("", re.compile(r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,}(?![0-9A-Za-z])"), _card),
}
_WORTH = re.compile("[0-9@]")


def _card_places(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Where a card may stand: whole groups of digits, 13 to 19 together; by start, the longest first."""
    for run in pattern.finditer(text):
        groups = [m.span() for m in re.compile("[0-9]+").finditer(text, *run.span())]
        for k, (a, _) in enumerate(groups):
            n, ends = 0, []
            for x, y in groups[k:]:
                n += y - x
                if n > 19:
                    break
                if n >= 13:
                    ends.append(y)
            yield from ((a, b) for b in reversed(ends))


def _iban_places(text: str, pattern: re.Pattern) -> Iterator[tuple[int, int]]:
    """Where an IBAN may stand: what the pattern takes, then the same without its last words, then later words."""
    at = 0
    while m := pattern.search(text, at):
        a, b = m.span()
        while b > a and sum(c != " " for c in text[a:b]) >= 15:
            yield a, b
            b = text.rfind(" ", a, b)
        at = a + 1


PLACES = {"card": _card_places, "iban": _iban_places}


def _placed(text: str, f: Feistel, kind: str, taken: list[tuple[int, int, str, str]], back: bool) -> list[tuple[int, int, str, str]]:
    """Replacements of a kind whose extent only its check decides: the first place that passes is taken.

    A replacement may make a place pass that failed: then it is permuted on until none does, together with those that
    share such a place.  Layout and places are kept, so turning back takes the same places and walks the same way.
    """
    _, pattern, permuted = KINDS[kind]
    spans: list[tuple[int, int]] = []
    failed: list[tuple[int, int]] = []
    end = 0
    for a, b in PLACES[kind](text, pattern):
        if a < end or any(x < b and a < y for x, y, _, _ in taken):
            continue
        if permuted(f, text[a:b], back) is None:
            failed.append((a, b))
        else:
            spans.append((a, b))
            end = b
    out, k = [], 0
    while k < len(spans):
        group, beside = [spans[k]], []
        k += 1
        while True:  # failed places that touch the group, and further replacements that those touch
            beside = [c for c in failed if any(c[0] < y and x < c[1] for x, y in group)]
            if k < len(spans) and any(c[0] < spans[k][1] and spans[k][0] < c[1] for c in beside):
                group.append(spans[k])
                k += 1
            else:
                break
        first, last = min(x for x, _ in group + beside), max(y for _, y in group + beside)
        part = text[first:last]
        while True:
            for a, b in group:
                part = part[: a - first] + permuted(f, part[a - first : b - first], back) + part[b - first :]
            if all(permuted(f, part[a - first : b - first], back) is None for a, b in beside):
                break
        out += [(a, b, kind, part[a - first : b - first]) for a, b in group]
    return out


def replacements(text: str, f: Feistel, back: bool = False) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, new value) of what is replaced, left to right, without overlaps."""
    if not _WORTH.search(text):
        return []
    taken: list[tuple[int, int, str, str]] = []
    for kind, (need, pattern, permuted) in KINDS.items():
        if need and need not in text:
            continue
        if kind in PLACES:
            taken += _placed(text, f, kind, taken, back)
            continue
        at = 0
        while m := pattern.search(text, at):
            a, b = m.span()
            at = b
            if any(x < b and a < y for x, y, _, _ in taken):
                continue
            new = permuted(f, text[a:b], back)
            if new is not None:
                taken.append((a, b, kind, new))
    return sorted(taken)


def pseudonymise_text(text: str, f: Feistel, back: bool = False) -> tuple[str, list[str]]:
    found = replacements(text, f, back)
    out, at = [], 0
    for a, b, _, new in found:
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), [k for _, _, k, _ in found]


def pseudonymise(df: DataFrame, key: bytes, *, text_col: str = "text", count_col: str = "n_replaced", kinds_col: str = "kinds", back: bool = False) -> DataFrame:
    """df with its text pseudonymised in place, how many values were replaced, and their kinds (sorted, comma-joined).

    Cards must pass Luhn's check, IBANs their remainder, SSNs and addresses their ranges, dates the calendar, phones a
    calling code and the length of a number; what does not pass is left as it is.  back=True turns the pseudonyms of the same key back.  Null texts stay null with none
    replaced; empty texts stay empty.  Every row is kept; an empty table stays empty; names that df has are refused.
    """
    clash = {c.lower() for c in df.columns} & {count_col.lower(), kinds_col.lower()}
    if clash:
        raise ValueError(f"the table already has {sorted(clash)}")
    schema = T.StructType([*(T.StructField(x.name, T.StringType()) if x.name == text_col else x for x in df.schema.fields), T.StructField(count_col, T.LongType()), T.StructField(kinds_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            done = [(None, []) if x is None else pseudonymise_text(x, f, back) for x in batch.column(text_col).to_pylist()]
            texts = pa.array([t for t, _ in done], pa.string())
            columns = [texts if n == text_col else c for n, c in zip(batch.schema.names, batch.columns)]
            columns += [pa.array([len(k) for _, k in done], pa.int64()), pa.array([",".join(sorted(set(k))) for _, k in done], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, count_col, kinds_col])

    return df.mapInArrow(run, schema)


def linked(df: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """How many documents each pseudonym links: (kind, pseudonym, documents).

    Cards, phones and IBANs are compared without spaces and signs, so that layouts link; other kinds as they are written.
    Null texts have none; rows that repeat an id are one document, null ids together too.  No rows for an empty table.
    """
    bare = lambda k, x: "".join(c for c in x if c.isalnum()) if k in ("card", "phone", "iban") else x

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Feistel(key)
        for batch in batches:
            rows = [(i, k, bare(k, new)) for i, t in zip(*(c.to_pylist() for c in batch.columns)) if t for _, _, k, new in replacements(t, f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "kind", "pseudonym"])

    found = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, kind string, pseudonym string")
    return found.distinct().groupBy("kind", "pseudonym").agg(F.count(F.lit(1)).alias("documents"))
