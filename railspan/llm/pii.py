"""Format-preserving Feistel pseudonyms for personal data.

Card numbers, bank accounts, social security and phone numbers, network addresses, dates and the local parts
of mail addresses are validated and then permuted, under a key, within their own format: separators, length,
check digits and calendar stay valid. A permutation keeps equal values equal in all documents and different
values different.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import string
import unicodedata
from collections.abc import Callable
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from railspan.llm.common import any_names, bound_batches, only

ROUNDS = 10
#: For tests and the check only: a production run passes its own secret.
DEFAULT_KEY = b"railspan-demo-key"

FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal()
KINDS = ("email", "ip", "card", "iban", "ssn", "date", "phone")
END = r"(?![A-Za-z0-9]|[.-]\d)"
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}+(?![0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.]*\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9.+-])(?:\d{13,19}|\d{4}(?:[\x20-]\d{4}){3}|\d{4}[\x20-]\d{6}[\x20-]\d{5})" + END,
    "ssn": r"(?<![A-Za-z0-9-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9]|-\d)",
    "date": r"(?<![A-Za-z0-9./-])(?:\d{4}(?P<ys>[-/.])\d{2}(?P=ys)\d{2}|\d{2}(?P<ds>[-/.])\d{2}(?P=ds)\d{4})(?!(?!T\d\d)[A-Za-z0-9]|[./-]\d)",
    "phone": r"(?<![A-Za-z0-9+])(?:\+\d{1,15}+(?:[\x20.-]?\(\d{1,5}\)|[\x20.-]\d{1,12}+|(?<=\))\d{1,12}+){0,7}"
             r"|(?:\(\d{2,4}\)|\d{2,4})(?:[\x20.-]\d{2,4}){2,4}" + END + ")",
}
FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS.items()))
EACH = {k: re.compile(p) for k, p in PATTERNS.items()}
#: A number in groups, for codes and lengths that no plan below knows.
GROUPED = re.compile(r"(?:\+\d{1,3}[\x20.-]?)?(?:\(\d{2,4}\)|\d{2,4})(?:[\x20.-]\d{2,4}){2,4}" + END)
NATIONAL = re.compile(r"(?:\(\d{3}\)[\x20.-]?\d{3}|\d{3}([\x20.-])\d{3}(?=\1))[\x20.-]\d{4}")
# Length of the accounts of each country (ISO 13616).
IBAN_SIZE = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FO,GL,NL,SD,FK 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK,MN 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,TL,SO 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM,BI,DJ "
    "28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}
# Country codes of one and two digits (all others have three), and least and most national digits.
SHORT_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
PLANS = {c: (int(lo), int(hi)) for c, lo, hi in (x.split(":") for x in (
    "1:10:10 7:10:10 20:8:10 27:9:9 30:10:10 31:9:9 32:8:9 33:9:9 34:9:9 36:8:9 39:8:11 40:9:9 41:9:9 43:7:12 44:9:10 45:8:8 46:7:9 47:8:8 48:9:9 49:7:11 "
    "52:10:10 54:10:11 55:10:11 56:9:9 57:8:10 60:8:10 61:9:9 62:8:12 63:8:10 64:8:10 65:8:8 66:8:9 81:9:10 82:8:10 84:9:10 86:10:11 90:10:10 91:10:10 "
    "92:9:10 351:9:9 353:7:9 358:7:11 359:8:9 370:8:8 371:8:8 372:7:8 380:9:9 385:8:9 386:8:8 420:9:9 421:9:9 852:8:8 886:8:9 966:8:9 971:8:9 972:8:9 974:8:8").split())}
TOKEN = re.compile(r"[A-Za-z0-9]+|.", re.S)
HAS = re.compile(r"[0-9@]")


class Feistel:
    """A keyed permutation of 0 .. size-1: alternating modular rounds on two digits of the value."""

    def __init__(self, key: bytes, kind: str):
        self.key, self.kind = key if len(key) <= 64 else hashlib.sha512(key).digest(), kind  # all of a long key counts

    def _round(self, i: int, value: int, size: int) -> int:
        return int.from_bytes(hashlib.blake2b(f"{self.kind}|{size}|{i}|{value}".encode(), key=self.key, digest_size=64).digest(), "big")

    def __call__(self, value: int, size: int) -> int:
        a = math.isqrt(max(size, 1) - 1) + 1
        while True:  # the square may be a little larger than the size: walk the cycle until back inside
            left, right = divmod(value, a)
            for i in range(ROUNDS):
                left, right = right, (left + self._round(i, right, size)) % a
            value = left * a + right
            if value < size:
                return value

    def within(self, value: int, size: int, valid: Callable[[int], bool]) -> int:
        """Permutes the valid values among themselves (a cycle from a valid value comes back to one)."""
        out = self(value, size)
        while not valid(out):
            out = self(out, size)
        return out


def luhn(digits: str) -> int:
    """Check digit of the digits before it."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def refill(shape: str, digits: str) -> str:
    """The shape with its digits replaced in turn."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in shape)


def _card(text: str, f: Feistel) -> str | None:
    digits = re.sub(r"\D", "", text)
    if len(set(digits)) == 1 or luhn(digits[:-1]) != int(digits[-1]):
        return None
    body = f"{f(int(digits[:-1]), 10 ** (len(digits) - 1)):0{len(digits) - 1}d}"
    return refill(text, body + str(luhn(body)))


def _iban(text: str, f: Feistel) -> str | None:
    flat = text.replace(" ", "")

    def mod97(s):
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97

    if not 15 <= len(flat) <= 34 or mod97(flat) != 1:
        return None
    body = flat[4:]
    sizes = [10 if c.isdigit() else 26 for c in body]
    value = 0
    for c, s in zip(body, sizes, strict=True):
        value = value * s + (int(c) if s == 10 else ord(c) - 65)
    size = 1
    for s in sizes:
        size *= s
    value, out = f(value, size), []
    for s in reversed(sizes):
        value, x = divmod(value, s)
        out.append(str(x) if s == 10 else chr(65 + x))
    new = flat[:2] + "00" + "".join(reversed(out))
    new = new[:2] + f"{98 - mod97(new):02d}" + new[4:]
    rest = iter(new)
    return "".join(c if c == " " else next(rest) for c in text)


def _ssn(text: str, f: Feistel) -> str | None:
    def valid(v):
        s = f"{v:09d}"
        return s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"

    v = int(text.replace("-", ""))
    return refill(text, f"{f.within(v, 10**9, valid):09d}") if valid(v) else None


def _date(text: str, f: Feistel) -> str | None:
    year_first = text[:4].isdigit()
    parts = [int(x) for x in re.split(r"\D", text)]
    for order in ((0, 1, 2),) if year_first else ((2, 1, 0), (2, 0, 1)):  # day first, else month first
        try:
            day = datetime.date(*(parts[i] for i in order)).toordinal()
        except ValueError:
            continue
        if not FIRST_DAY <= day < LAST_DAY:
            return None
        new = datetime.date.fromordinal(FIRST_DAY + f(day - FIRST_DAY, LAST_DAY - FIRST_DAY))
        # A day that some format leaves ambiguous keeps to days that are so, and others likewise: one date has one pseudonym in all formats.
        both = parts[order[2]] <= 12
        while (new.day <= 12) != both:
            new = datetime.date.fromordinal(FIRST_DAY + f(new.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY))
        values = [0, 0, 0]
        for i, v in zip(order, (new.year, new.month, new.day), strict=True):
            values[i] = v
        return refill(text, "".join(f"{v:0{4 if i == order[0] else 2}d}" for i, v in enumerate(values)))
    return None


def _ip(text: str, f: Feistel) -> str | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    v = f(int.from_bytes(bytes(octets), "big"), 1 << 32)
    return ".".join(map(str, v.to_bytes(4, "big")))


def _code(text: str) -> str:
    """The country code as it is set apart, else by the world's plan; empty without a plus."""
    if text[0] != "+":
        return ""
    apart = re.match(r"\+\d{1,3}(?=\D)", text)
    return apart.group() if apart else text[: 1 + next((n for n in (1, 2) if text[1 : 1 + n] in SHORT_CODES), 3)]


def _planned(text: str) -> bool:
    """Whether the number has a length of its country's plan, or the form of a North American one."""
    code = _code(text)
    if not code:
        return NATIONAL.fullmatch(text) is not None
    if code[1:] not in SHORT_CODES and len(code) < 4:
        return False
    least, most = PLANS.get(code[1:], (7, 16 - len(code)))
    return least <= sum(c.isdigit() for c in text[len(code) :]) <= most


def readings(kind: str, text: str, m: re.Match) -> list[int]:
    """Where a value that begins at the match may end, best reading first."""
    if kind == "iban":
        size = IBAN_SIZE.get(m.group()[:2], 0)
        part = re.compile(rf"[A-Z0-9](?:\x20?[A-Z0-9]){{{size - 1}}}(?![A-Za-z0-9])").match(text, m.start()) if size else None
        return [part.end(), m.end()] if part else [m.end()]
    if kind == "phone":
        stop = re.compile(END)
        ends = [x.end() for x in re.finditer(r"\d+\)?", m.group())][::-1]
        ends = [m.start() + e for e in ends if stop.match(text, m.start() + e)]
        grouped = GROUPED.match(text, m.start())
        return [e for e in ends if _planned(text[m.start() : e])] + ([grouped.end()] if grouped else [])
    return [m.end()]


def _phone(text: str, f: Feistel) -> str | None:
    lead = _code(text)
    body = text[len(lead) :]
    digits = re.sub(r"\D", "", body)
    if not _planned(text):
        coded = lead and not text[len(lead)].isdigit()
        if not 7 <= len(digits) <= 14 or len(digits) + len(lead) > 16 or not (coded or "(" in text and not lead):
            return None
    return lead + refill(body, f"{f(int(digits), 10 ** len(digits)):0{len(digits)}d}")


@cache
def _letters(c: str) -> str:
    """The characters that may stand for c: of its kind among ASCII, else of its category among the 256 code points around it."""
    for group in (string.digits, string.ascii_lowercase, string.ascii_uppercase):
        if c in group:
            return group
    if ord(c) < 128 or not c.isalnum():
        return ""
    low = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(low, 128), low + 256)) if unicodedata.category(x) == unicodedata.category(c) and x.isalnum())


def _letters_of(part: str, f: Feistel) -> str:
    kinds = [_letters(c) for c in part]
    value, size = 0, 1
    for c, k in zip(part, kinds, strict=True):
        if k:
            value, size = value * len(k) + k.index(c), size * len(k)
    value, out = f(value, size), []
    for c, k in zip(reversed(part), reversed(kinds), strict=True):
        if k:
            value, x = divmod(value, len(k))
            c = k[x]
        out.append(c)
    return "".join(reversed(out))


def _email(text: str, f: Feistel) -> str | None:
    """The part before the @, 64 characters at a time, each of them under the pseudonym of what stands before it: equal parts stay equal."""
    local, _, domain = text.partition("@")
    done = _letters_of(local[:64], f)
    for at in range(64, len(local), 64):
        done += _letters_of(local[at : at + 64], Feistel(f.key, f"{f.kind}|{done[-64:]}|{at}"))
    return f"{done}@{domain}"


MAKERS = {"email": _email, "ip": _ip, "card": _card, "iban": _iban, "ssn": _ssn, "date": _date, "phone": _phone}


class Pseudonyms:
    """Replaces what it finds in a text; the same value becomes the same pseudonym everywhere."""

    LIMIT = 50_000

    def __init__(self, key: bytes):
        self.permute = {k: Feistel(key, k) for k in KINDS}
        self.known: dict[tuple[str, str], str | None] = {}

    def of(self, kind: str, value: str) -> str | None:
        if (kind, value) not in self.known:
            if len(self.known) >= self.LIMIT:
                self.known.clear()
            self.known[kind, value] = MAKERS[kind](value, self.permute[kind])
        return self.known[kind, value]

    def replace(self, text: str) -> tuple[str, dict[str, int]]:
        counts = dict.fromkeys(KINDS, 0)
        if not HAS.search(text):
            return text, counts

        out, done, at = [], 0, 0
        while m := FIND.search(text, at):
            start = m.start()
            found = self._read(text, m)
            if found is None:  # one token later another value may begin
                at = TOKEN.match(text, start).end()
                continue
            kind, at, new = found
            counts[kind] += 1
            out += (text[done:start], new)
            done = at
        return "".join((*out, text[done:])), counts

    def _read(self, text: str, m: re.Match) -> tuple[str, int, str] | None:
        """Kind, end and pseudonym of the first valid reading at the match's start."""
        kinds = list(PATTERNS)
        for kind in kinds[kinds.index(m.lastgroup) :]:
            one = m if kind == m.lastgroup else EACH[kind].match(text, m.start())
            for end in readings(kind, text, one) if one else ():
                new = self.of(kind, text[m.start() : end])
                if new is not None:
                    return kind, end, new
        return None


def _run(key: bytes, counts: bool):
    def run(batches):
        names = Pseudonyms(key)
        for batch in batches:
            done = [names.replace(t) if t else (t, dict.fromkeys(KINDS, 0)) for t in batch.column("text").to_pylist()]
            cols = [batch.column(c) if c != "text" else pa.array([t for t, _ in done], pa.string()) for c in batch.schema.names]
            more = {f"n_{k}": pa.array([n[k] for _, n in done], pa.int64()) for k in KINDS} if counts else {}
            yield pa.RecordBatch.from_arrays([*cols, *more.values()], names=[*batch.schema.names, *more])

    return run


def session_key(spark: SparkSession) -> bytes:
    """The secret set as spark.railspan.pseudonymKey; without it the demonstration key, which protects nothing."""
    return spark.conf.get("spark.railspan.pseudonymKey", DEFAULT_KEY.decode()).encode()


def pseudonymise(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """doc_id, text with pseudonyms, and n_<kind>, the number of replaced values of each kind, for each row.

    A null text stays null, an empty one empty. What looks like a value but fails its validation stays as it
    is. Rows are independent: no shuffle, repeated rows give repeated results, other columns are ignored.
    """
    bound_batches(docs.sparkSession)
    return only(docs, doc_id="long", text="string").mapInArrow(_run(key, True), "doc_id long, text string, " + ", ".join(f"n_{k} long" for k in KINDS))


@any_names
def pseudonymise_table(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """docs with pseudonyms in text; all rows and columns, whatever their names, stay. Nulls and empty tables as in pseudonymise."""
    bound_batches(docs.sparkSession)
    text_as_string = docs.withColumn("text", docs["text"].cast("string"))
    return text_as_string.mapInArrow(_run(key, False), text_as_string.schema)
