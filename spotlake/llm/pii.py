"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, `+` before a digit, digits that meet a digit or a dot, schemes and identifier
cues.  Deterministic parsers grow each anchor to its span and validate it:

email    local part, `@`, host with a dot
ip       four dotted numbers up to 255
card     12 to 19 digits, parted by single blanks or hyphens, Luhn
phone    `+` and 9 to 15 digits
address  a URL with a user in front of its host, scheme://user@host or scheme://user:word@host
account  a secret or number behind a cue: password, passwd, pwd, token, secret, api_key, ssn, iban, account, acct (with `=`, `:` or blanks
         and quotes between), of 6 characters or more with a digit; an AKIA key of 20; an IBAN behind its cue must pass its check digits

The first four are exactly the leftmost, non-overlapping matches of the patterns in `BASE`, of which failing ones are dropped without a retry; a
parser never looks at a place twice, so a text takes time linear in its length.

Defined cases: a null is an empty text; texts without anchors give no spans; kinds may overlap each other; a null id is a row like any
other; repeated rows all come out; offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .shared import table, tune

#: What the parsers of the first four kinds must agree with (fixed values).
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = ("email", "ip", "card", "phone", "address", "account")
CUES = ("password", "passwd", "pwd", "token", "secret", "api_key", "ssn", "iban", "account", "acct")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://")
_DIGITS = frozenset("0123456789")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_LOCAL = _ALNUM | frozenset("._%+-")
_LABEL = _ALNUM | frozenset("-")
_PHONE = _DIGITS | frozenset(" ().-")
_SECRET = _ALNUM | frozenset("._%+-/=~")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton():
    """Anchors, each with the parser it wakes."""
    a = ahocorasick.Automaton()
    a.add_word("@", ("email", 1))
    for d in "0123456789":
        a.add_word("+" + d, ("phone", 2))
        for e in "0123456789":
            a.add_word(d + e, ("card", 2))
            a.add_word(f"{d} {e}", ("card", 3))
            a.add_word(f"{d}-{e}", ("card", 3))
            a.add_word(f"{d}.{e}", ("ip", 3))
    for x in SCHEMES:
        a.add_word(x, ("address", len(x)))
    for x in CUES:
        a.add_word(x, ("account", len(x)))
    a.add_word("akia", ("akia", 4))
    a.make_automaton()
    return a


def _run(t: str, i: int, chars: frozenset, n: int) -> int:
    while i < n and t[i] in chars:
        i += 1
    return i


def _back(t: str, i: int, chars: frozenset, floor: int) -> int:
    while i > floor and t[i - 1] in chars:
        i -= 1
    return i


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def iban_ok(s: str) -> bool:
    """ISO 13616 check digits."""
    s = s.replace(" ", "").upper()
    if not 15 <= len(s) <= 34 or not (s[:2].isascii() and s[:2].isalpha() and s[2:4].isdigit() and set(s) <= _ALNUM):
        return False
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _email(t: str, at: int, floor: int, n: int):
    """(span or None, where the next may begin)."""
    s = _back(t, at, _LOCAL, floor)
    e = _run(t, at + 1, _LABEL, n)
    if s == at or e == at + 1:
        return None, floor
    dots = 0
    while e < n - 1 and t[e] == "." and t[e + 1] in _LABEL:
        e = _run(t, e + 1, _LABEL, n)
        dots += 1
    return ((s, e), e) if dots else (None, floor)


def _ip(t: str, at: int, floor: int, n: int):
    s = _back(t, at, _DIGITS, floor)
    e, parts, begin = _run(t, at, _DIGITS, n), 1, s
    numbers = [t[begin:e]]
    while parts < 4 and e < n - 1 and t[e] == "." and t[e + 1] in _DIGITS:
        begin = e + 1
        e = _run(t, begin, _DIGITS, n)
        numbers.append(t[begin:e])
        parts += 1
    if parts < 4:
        return None, None
    return ((s, e) if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in numbers) else None), e


def _card(t: str, at: int, floor: int, n: int):
    s = _back(t, at, _DIGITS, floor)
    e = s
    while True:
        e = _run(t, e, _DIGITS, n)
        if e < n - 1 and t[e] in " -" and t[e + 1] in _DIGITS:
            e += 1
        else:
            break
    digits = [c for c in t[s:e] if c in _DIGITS] if e - s <= 64 else []
    return ((s, e) if 12 <= len(digits) <= 19 and luhn("".join(digits)) else None), e


def _phone(t: str, at: int, n: int):
    e = _run(t, at + 2, _PHONE, n)
    while e > at + 2 and t[e - 1] not in _DIGITS:
        e -= 1
    if e < at + 4:  # a sign, a digit, one more and the last digit at least
        return None, at + 1
    digits = sum(c in _DIGITS for c in t[at:e])
    return ((at, e) if 9 <= digits <= 15 else None), e


def _address(t: str, at: int, end: int, n: int):
    """A URL whose authority has a user."""
    i = end
    while i < n and t[i] not in "/?# \t\n\r\x0b\x0c\"'<>":
        i += 1
    user, sign, host = t[end:i].rpartition("@")
    if not sign or not user or not host or host[0] not in _ALNUM:
        return None
    while i > end and t[i - 1] in ".,;:!)":
        i -= 1
    return (at, i)


def _account(t: str, cue: str, end: int, n: int):
    """The value behind a cue."""
    i = end
    mark = False
    while i < n and t[i] in " =:\"'" and i - end < 8:
        mark |= t[i] in "=:"
        i += 1
    if i == end:
        return None
    e = _run(t, i, _SECRET, n)
    while e > i and t[e - 1] in ".-/=~":
        e -= 1
    if cue == "iban":
        for stop in range(min(n, i + 42), i + 14, -1):
            if t[stop - 1] in _ALNUM and iban_ok(t[i:stop]):
                return (i, stop)
        return None
    value = t[i:e]
    if len(value) < 6 or not any(c in _DIGITS for c in value):
        return None
    if not mark and not all(c in _DIGITS or c == "-" for c in value):
        return None
    return (i, e)


def spans(text: str, anchors) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of everything found, ordered by start, then kind."""
    out, n = [], len(text)
    free = dict.fromkeys(("email", "ip", "card", "phone", "address", "account"), 0)
    low = text.lower()
    for last, (kind, size) in anchors.iter(low if len(low) == n else text.translate(_LOWER)):
        at = last + 1 - size
        if kind == "email":
            if at >= free["email"]:
                span, free["email"] = _email(text, at, free["email"], n)
                if span:
                    out.append((span[0], 0, span[1]))
        elif kind == "ip":
            # the search resumes behind the last match; a run that is too short leaves its numbers to the next start
            if at >= free["ip"]:
                s = _back(text, at, _DIGITS, free["ip"])
                span, after = _ip(text, s, free["ip"], n)
                if after is not None:
                    free["ip"] = after
                    if span:
                        out.append((span[0], 1, span[1]))
        elif kind == "card":
            if at >= free["card"]:
                span, free["card"] = _card(text, at, free["card"], n)
                if span:
                    out.append((span[0], 2, span[1]))
        elif kind == "phone":
            if at >= free["phone"]:
                span, free["phone"] = _phone(text, at, n)
                if span:
                    out.append((span[0], 3, span[1]))
        elif kind == "address":
            if at >= free["address"]:
                span = _address(text, at, last + 1, n)
                if span:
                    free["address"] = span[1]
                    out.append((span[0], 4, span[1]))
        elif at >= free["account"]:
            if kind == "akia":
                e = _run(text, at, _ALNUM, n)
                span = (at, e) if e - at == 20 and text[at:e].isupper() and (at == 0 or text[at - 1] not in _ALNUM) else None
            else:
                span = _account(text, text[at : last + 1].lower(), last + 1, n) if at == 0 or text[at - 1] not in _ALNUM else None
            if span:
                free["account"] = span[1]
                out.append((span[0], 5, span[1]))
    out.sort()
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The first four kinds by their patterns: what the parsers are tested against."""
    out = []
    for k, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text):
            s = m.group()
            digits = "".join(c for c in s if c in _DIGITS)
            if kind == "email" or kind == "ip" and all(int(x) <= 255 for x in s.split(".")) or kind == "card" and 12 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def joined(found) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in found)


def find(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and spans array<struct<kind, start, end>> of every row."""
    tune(df.sparkSession)

    def run(batches):
        anchors = automaton()
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            got = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t, anchors)] if t else [] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, kind)], names=["k", "spans"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(df[key].alias("k"), text).mapInArrow(run, f"k {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("k", key)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: counts, digests and spans."""
    found = find(table(spark, sf_dir, "documents"))

    def run(batches):
        for b in batches:
            rows = [[(s["start"], KINDS.index(s["kind"]), s["end"]) for s in x] for x in b.column(1).to_pylist()]
            counts = [pa.array([sum(k == i for _, k, _ in x) for x in rows], pa.int64()) for i in range(4)]
            sha = [hashlib.sha256(joined(x for x in r if x[1] < 4).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sha), pa.array([joined(r) for r in rows])], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return found.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
