"""Anchor expansion against plain patterns, and each added kind."""

import hashlib
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from eventfold.llm import pii

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, found):
    digits = [int(c) for c in found if c in "0123456789"]
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in found.split("."))
    if kind == "phone":
        return 8 <= len(digits) <= 15
    if kind == "card":
        odd, even = digits[::-1][::2], digits[::-1][1::2]
        return 16 <= len(digits) <= 19 and (sum(odd) + sum(sum(divmod(2 * d, 10)) for d in even)) % 10 == 0
    return True


def plain(text):
    return [(k, m.start(), m.end()) for k, p in RULES.items() for m in re.finditer(p, text) if passes(k, m.group())]


def base(text):
    return [(pii.KINDS[k], s, e) for k, s, e in pii.spans_of(text) if pii.KINDS[k] in pii.BASE]


def added(text):
    return [(pii.KINDS[k], text[s:e]) for k, s, e in pii.spans_of(text) if pii.KINDS[k] not in pii.BASE]


CHARS = st.one_of(st.sampled_from("@@..--++()  0123456789aZ_%é中😀\n:"), st.sampled_from(["@a.b", "1.2.3.4", "4736962573099581", "+1 (017) 555-7713", "256.", ".255", "x@"]))


@settings(max_examples=1500, deadline=None)
@given(st.lists(CHARS, max_size=40).map("".join))
def test_base_spans_equal_plain_patterns(text):
    assert base(text) == plain(text)


def test_edges_of_base_spans():
    for text in ("a@b@c.d", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "300.1.1.1.1.1.1", "01.002.0003.00004", "+12", "+1 2", "+1-2345678-", "@a.b", "9" * 5000 + ".1.1.1", ""):
        assert base(text) == plain(text)


def test_long_texts_are_linear():
    long = {"a" * 400_000 + "@": 0, "1" * 400_000: 0, "1." * 200_000: 50_000, "+1 " * 130_000: 0, "DE" * 200_000: 0, "a@" * 200_000: 0, "account " * 50_000: 0}
    began = time.time()
    for text, n in long.items():
        assert len(pii.spans_of(text)) == n
    assert time.time() - began < 60


def test_added_kinds():
    assert added("pay to DE89 3704 0044 0532 0130 00, now") == [("iban", "DE89 3704 0044 0532 0130 00")]
    assert added("GB82WEST12345698765432.") == [("iban", "GB82WEST12345698765432")]
    assert added("GB82WEST12345698765433 and XGB82WEST12345698765432") == []
    assert added("Account number: 1234-5678-90 please") == [("account", "1234-5678-90")]
    assert added("SSN 078-05-1120") == [("account", "078-05-1120")]
    assert added("account of the year, and accounting 12345678") == []
    assert added("see ftp://bob:pa55@host.example.org:21/x and http://host/a@b") == [("login", "bob:pa55@host.example.org:21")]
    assert added("tel:+49-30-1234567.") == [("contact", "tel:+49-30-1234567")]
    assert added("jörg@müller.de")[0] == ("mail_intl", "jörg@müller.de")


def test_redaction_joins_overlapping_spans():
    assert pii.redacted("write mailto:a.b@c.de or +1 (017) 555-7713.") == "write [CONTACT] or [PHONE]."
    assert pii.redacted("nothing here") == "nothing here"


def test_find_and_redact_tables(docs):
    rows = [(1, "x a@b.cd y"), (1, "x a@b.cd y"), (2, None), (None, ""), (3, "é😀 1.2.3.4")]
    found = pii.find(docs(rows)).collect()
    assert sorted(((r.doc_id or 0, [(s.kind, s.start, s.end, s.value) for s in r.spans]) for r in found)) == [
        (0, []), (1, [("email", 2, 8, "a@b.cd")]), (1, [("email", 2, 8, "a@b.cd")]), (2, []), (3, [("ip", 3, 10, "1.2.3.4")]),
    ]
    back = pii.redact(docs(rows))
    assert back.columns == docs(rows).columns
    assert sorted(r.text or "" for r in back.collect()) == ["", "", "x [EMAIL] y", "x [EMAIL] y", "é😀 [IP]"]
    assert pii.find(docs([])).count() == 0 and pii.redact(docs([])).count() == 0


def test_query_equals_plain_patterns(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = pii.pii_anchors(spark, sf).collect()
    assert len(got) == len(texts) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in got) > 0
    for r in got:
        want = plain(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for k, _, _ in want) for x in pii.BASE)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert r.spans.startswith(joined)
