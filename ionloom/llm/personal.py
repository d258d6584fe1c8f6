"""Personal data by anchor expansion.

One Aho-Corasick automaton finds the anchors of all kinds in a text: at-signs, schemes,
plus signs before a digit, digits and cue words for identifiers. Deterministic parsers expand
each anchor to the boundaries of its finding and validate it.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ionloom.llm import spans
from ionloom.llm.common import text_slices

BASE = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans of one start are listed; the last two go beyond the base.
KINDS = (*BASE, "login", "account")

DIGITS = "0123456789"
#: Cue words of identifiers, in lower case; a cue counts at a word boundary.
CUES = ("iban", "ssn", "passport", "account no", "account number", "acct", "social security")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"[0-9][ ().0-9-]*")
_LOGIN = re.compile(r"[A-Za-z0-9._~%!$&'*+;=-]+:[^\s/@:]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*(?::[0-9]+)?")
_SCHEME = re.compile(r"[A-Za-z]")
_SCHEME_RUN = re.compile(r"[A-Za-z0-9+.-]*\Z")
_VALUE = re.compile(r"[\s:#=.]*(?:is\s+|no\.?\s+|number\s+)?([A-Z0-9](?:[ -]?[A-Z0-9])*)")
_DIGIT_RUN = re.compile(r"[0-9]+")
# How far to the left the local part of an address, or a scheme, is looked for at once.
_LOOK = 64


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    a.add_word("@", "@")
    a.add_word("://", ":")
    for d in DIGITS:
        a.add_word(d, "d")
        a.add_word(f"+{d}", "+")
    for cue in CUES:
        for form in (cue, cue.upper(), cue.capitalize(), cue.title()):
            a.add_word(form, f"c{len(cue)}")
    a.make_automaton()
    return a


_ANCHORS = _automaton()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def iban(value: str) -> bool:
    """Country, check digits and remainder 1 modulo 97."""
    if not re.fullmatch(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", value):
        return False
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def _run_start(text: str, at: int, floor: int, run: re.Pattern) -> int:
    """Where the ``run`` of characters that ends at ``at`` begins, not before ``floor``."""
    look = _LOOK
    while True:
        low = max(floor, at - look)
        start = low + run.search(text[low:at]).start()
        if start > low or low == floor:
            return start
        look *= 4


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def _emails(text: str, signs: list[int]) -> Iterator[spans.Span]:
    end = 0
    for at in signs:
        if at < end:
            continue
        start = _run_start(text, at, end, _LOCAL)
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            yield "email", start, end


def _digit_runs(text: str, digits: list[int]) -> list[tuple[int, int]]:
    """Maximal runs of digits, expanded from the digit anchors."""
    runs: list[tuple[int, int]] = []
    end = -1
    for at in digits:
        if at >= end:
            end = _DIGIT_RUN.match(text, at).end()
            runs.append((at, end))
    return runs


def _ips(text: str, runs: list[tuple[int, int]]) -> Iterator[spans.Span]:
    """Four runs joined by single dots; chains are read in fours from the left."""
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] == a[1] + 1 and text[a[1]] == "." for a, b in zip(four, four[1:], strict=False)):
            if all(_octet(text[a:b]) for a, b in four):
                yield "ip", four[0][0], four[3][1]
            i += 4
        else:
            i += 1


def _cards(text: str, runs: list[tuple[int, int]]) -> Iterator[spans.Span]:
    """Runs joined by single spaces or hyphens."""
    i = 0
    while i < len(runs):
        j, count = i, runs[i][1] - runs[i][0]
        while j + 1 < len(runs) and runs[j + 1][0] == runs[j][1] + 1 and text[runs[j][1]] in " -":
            j += 1
            count += runs[j][1] - runs[j][0]
        if 14 <= count <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            yield "card", runs[i][0], runs[j][1]
        i = j + 1


def _phones(text: str, plus: list[int]) -> Iterator[spans.Span]:
    end = 0
    for at in plus:
        if at < end:
            continue
        body = _PHONE.match(text, at + 1).group().rstrip(" ().-")
        if len(body) >= 3:
            end = at + 1 + len(body)
            if 10 <= sum(c in DIGITS for c in body) <= 15:
                yield "phone", at, end


def _logins(text: str, schemes: list[int]) -> Iterator[spans.Span]:
    """Addresses with a user and password: scheme://user:password@host."""
    for at in schemes:
        login = _LOGIN.match(text, at + 3)
        scheme = _SCHEME.search(text, _run_start(text, at, 0, _SCHEME_RUN), at) if login else None
        if scheme:
            yield "login", scheme.start(), login.end()


def _accounts(text: str, cues: list[tuple[int, int]]) -> Iterator[spans.Span]:
    """The value after a cue, if it has 6 to 34 letters and digits, 6 of them digits, or is an IBAN."""
    end = 0
    for start, stop in cues:
        if start < end or (start and text[start - 1].isalnum()) or text[stop : stop + 1].isalnum():
            continue
        value = _VALUE.match(text, stop)
        if not value:
            continue
        plain = re.sub(r"[ -]", "", value[1])
        cue = text[start:stop].lower()
        valid = iban(plain) if cue == "iban" else 6 <= len(plain) <= 34 and sum(c in DIGITS for c in plain) >= 6
        if valid:
            end = value.end(1)
            yield "account", value.start(1), end


def find(text: str) -> list[spans.Span]:
    """All findings of a text, as kind, start and end in code points."""
    signs, plus, schemes, digits, cues = [], [], [], [], []
    for last, kind in _ANCHORS.iter(text):
        if kind == "d":
            digits.append(last)
        elif kind == "@":
            signs.append(last)
        elif kind == "+":
            plus.append(last - 1)
        elif kind == ":":
            schemes.append(last - 2)
        else:
            cues.append((last + 1 - int(kind[1:]), last + 1))
    if not (signs or digits or cues):
        return []
    runs = _digit_runs(text, digits)
    found = [*_emails(text, signs), *_ips(text, runs), *_cards(text, runs), *_phones(text, plus), *_logins(text, schemes)]
    taken = sorted((a, b) for _, a, b in found)
    reach = list(accumulate((b for _, b in taken), max))  # the furthest end of the spans so far
    for kind, a, b in _accounts(text, sorted(cues)):
        i = bisect_left(taken, (b, 0))
        if not i or reach[i - 1] <= a:
            found.append((kind, a, b))
    return found


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, a count per base kind, ``base_sha256`` and ``spans``.

    Offsets count code points, ends are exclusive. Null and empty texts have no findings;
    repeated rows are scanned alike; very long texts are scanned whole; an empty table gives no
    rows; extra columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    counts = [f"n_{k}" for k in BASE]
    names = ["doc_id", *counts, "base_sha256", "spans"]

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for start, texts in text_slices(batch, "text"):
                found = [find(t) for t in texts]
                base = [[s for s in f if s[0] in BASE] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(texts)),
                        *[pa.array([sum(s[0] == k for s in f) for f in base], pa.int64()) for k in BASE],
                        pa.array([spans.digest(spans.joined(f, KINDS)) for f in base], pa.string()),
                        pa.array([spans.joined(f, KINDS) for f in found], pa.string()),
                    ],
                    names=names,
                )

    return rows.mapInArrow(batches, f"doc_id {id_type}, " + "".join(f"{c} long, " for c in counts) + "base_sha256 string, spans string")
