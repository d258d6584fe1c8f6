"""Secrets and personal data against the plain patterns."""

import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from ionloom.llm import personal, secrets, spans
from tests.llm.rows import none, odd

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def _luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(digits[::-1])]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def _personal(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


PIECES = ["@", "a", "b.", "1", "25", ".", "+", "-", " ", "(", "300", "0", "é", "%", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "٣"]


@settings(max_examples=2000, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=16).map("".join))
def test_personal_base_equals_patterns(text):
    assert sorted(s for s in personal.find(text) if s[0] in personal.BASE) == _personal(text)


def test_personal_beyond_the_base():
    text = "see ftp://bob:pw1@files.example.org/x, IBAN: GB82 WEST 1234 5698 7654 32, SSN 078-05-1120; account no. 12 of 30"
    found = {(k, text[a:b]) for k, a, b in personal.find(text) if k not in personal.BASE}
    assert found == {
        ("login", "ftp://bob:pw1@files.example.org"),
        ("account", "GB82 WEST 1234 5698 7654 32"),
        ("account", "078-05-1120"),
    }
    assert personal.find("IBAN: GB83 WEST 1234 5698 7654 32. The account number of items grew.") == []


def test_schemes_and_overlaps_of_any_length():
    for n in (1, 63, 64, 65, 100, 5000):
        text = "1" + "a" * n + "://user:pw@host.org"
        assert ("login", 1, len(text)) in personal.find(text)
    assert not [s for s in personal.find("1+://user:pw@host.org") if s[0] == "login"]
    # The value lies in a login that begins before five other findings.
    text = "ftp://u:iban=a@b.c,1.2.3.4,1.2.3.5,1.2.3.6,acct:123456@host.org"
    found = personal.find(text)
    assert [s for s in found if s[0] == "login"] and not [
        s for s in found if s[0] == "account" and any(o[0] != "account" and o[1] < s[2] and s[1] < o[2] for o in found)
    ]


def test_long_hostile_texts_stay_linear():
    assert personal.find("a" * 300_000 + "@" + "b" * 300_000) == []
    assert len(personal.find("a@b" * 50_000 + ".c")) == 1
    assert personal.find("1" * 200_000) == []


def _scan_matches(spark, got, brute, kinds):
    texts = {r["doc_id"]: r["text"] or "" for r in odd(spark).collect()}
    assert len(got) == odd(spark).count()
    for r in got:
        if r["doc_id"] is None:
            continue
        base = brute(texts[r["doc_id"]])
        assert r["base_sha256"] == spans.digest(spans.joined(base, kinds))
        counts = Counter(s[0] for s in base)
        assert all(r[c] == counts[c[2:]] for c in r.asDict() if c.startswith("n_"))
        assert set(filter(None, spans.joined(base, kinds).split(","))) <= set(r["spans"].split(","))


def test_personal_scan(spark):
    _scan_matches(spark, personal.scan(odd(spark)).collect(), _personal, personal.KINDS)
    assert personal.scan(none(spark)).count() == 0


ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def _secrets(text):
    out = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if m.end() - m.start() >= 24]
    return out


def test_secret_scan(spark):
    _scan_matches(spark, secrets.scan(odd(spark)).collect(), _secrets, secrets.KINDS)
    assert secrets.scan(none(spark)).count() == 0


def _hexes(n, size, salt):
    import hashlib

    return [hashlib.sha256(f"{salt}{i}".encode()).hexdigest()[:size] for i in range(n)]


def test_automata_tell_formats_from_words(spark):
    keys = ["AKIA" + h.upper().replace("0", "Z") for h in _hexes(150, 16, "k")]
    words = ["".join(("an", "the", "ing", "ous")[int(c, 16) % 4] for c in h) for h in _hexes(300, 8, "w")]
    texts = [f"{w} and token: {h} or {k} {w[::-1]}" for w, h, k in zip(words, _hexes(150, 32, "h"), keys, strict=False)]
    texts += [f"bare {h} here" for h in _hexes(20, 20, "bare")] + [f"plain {w} text" for w in words]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secrets.scan(docs).collect()}
    assert all("inferred:5:25" == found[150 + i] for i in range(20))
    assert not any(found[170 + i] for i in range(300))


def test_merging_keeps_probabilities_proper():
    # Lengths fall off evenly, so every stop is as likely as the one before and the states loop.
    values = [v for k in range(1, 8) for v in ["ab" * k] * (1024 >> k)]
    automaton = secrets.infer(values)
    assert len(automaton.stop) <= 4
    assert automaton.score("abab") > automaton.score("abba") + 5
    assert secrets.infer([]).score("x") < 0


def test_no_credentials_infer_nothing(spark):
    docs = spark.createDataFrame([(1, "Zx9" * 20)], "doc_id long, text string")
    assert secrets.scan(docs).first()["spans"] == ""
