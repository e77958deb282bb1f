"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes of
contact and login addresses, cue words of account numbers, and the country codes that open
an IBAN. At each anchor a local parser decides where the span begins and ends and whether
it is valid; a parser reads only around its anchor, moves forward, and uses patterns that
cannot backtrack over what they have read, so the work is linear in the text.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are those of the plain rules (leftmost,
non-overlapping, failing matches dropped and not tried again). The others add spans:

- ``iban``: country code, check digits and the country's length, remainder 1 modulo 97; single
  spaces may part groups.
- ``account``: 6 to 20 letters and digits, at least 5 of them digits, with single separators (a space only before a digit), behind a cue
  word and at most CUE_GAP characters of connecting text; the span is the number alone.
- ``login``: ``scheme://user:password@host``, from the user on.
- ``contact``: ``mailto:``, ``tel:``, ``sip:``, ``sips:``, ``xmpp:`` or ``skype:`` with what they name.
- ``mail_intl``: an at-sign between names with letters beyond ASCII, which ``email`` cuts off.

Defined cases: a null text is an empty one; texts without a finding have an empty list.
Offsets count code points, ends are exclusive. Everything stays within a row: repeated rows
get equal rows, an empty table gives none, other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventfold.llm.base import register, table

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "account", "login", "contact", "mail_intl")
CUES = (
    "account", "acct", "a/c", "account number", "konto", "kontonummer", "kontonr", "compte", "cuenta", "customer no",
    "customer number", "kundennummer", "passport", "passport no", "reisepass", "passeport", "pasaporte", "ssn", "social security",
    "tax id", "steuer-id", "sort code", "routing number", "driver's license", "member id", "national id", "dni", "nie",
)
CUE_GAP = 16
SCHEMES = ("http://", "https://", "ftp://", "ftps://", "sftp://", "ssh://", "postgres://", "postgresql://", "mysql://", "mongodb://", "redis://", "amqp://")
CONTACTS = ("mailto:", "tel:", "sip:", "sips:", "xmpp:", "skype:")
#: Lengths of an IBAN by country (ISO 13616).
IBAN = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29,
    "PT": 25, "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ALNUM = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_RUN = re.compile(r"[0-9]++")
_IP = re.compile(r"([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,27}")
_GAP = re.compile(r"[\x20\t:=#.]*(?:(?:no|nr|num|number|id|is)\b[\x20\t:=#.]*)?", re.IGNORECASE)
_NUMBER = re.compile(r"[A-Za-z0-9](?:(?:\x20(?=[0-9])|[/-])?[A-Za-z0-9]){5,19}(?![A-Za-z0-9])")
_LOGIN = re.compile(r"([^\s/?#@:]++:[^\s/?#@]++@)([^\s/?#@:]++)(?::[0-9]++)?+")
_NAMED = re.compile(r"[A-Za-z0-9._%+@:()~-]++")
_WIDE_HOST = re.compile(r"[\w-]++(?:\.[\w-]++)++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def iban_ok(text: str) -> bool:
    """Length and check digits of an IBAN without spaces."""
    if IBAN.get(text[:2]) != len(text):
        return False
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


class Parsers:
    """Local parsers over one text. Each keeps where its last match ended; anchors come in order."""

    def __init__(self, text: str):
        self.text, self.found, self.until = text, {k: [] for k in KINDS}, dict.fromkeys(KINDS, 0)

    def add(self, kind: str, start: int, end: int) -> None:
        self.found[kind].append((start, end))
        self.until[kind] = end

    def at_sign(self, at: int, _: int) -> None:
        start, low = at, self.until["email"]
        while start > low and self.text[start - 1] in _LOCAL:
            start -= 1
        m = _HOST.match(self.text, at + 1)
        if start < at and m:
            self.add("email", start, m.end())
        self.wide_mail(at, m.end() if start < at and m else -1, start)

    def wide_mail(self, at: int, plain_end: int, plain_start: int) -> None:
        """A mail address with letters beyond ASCII, unless the plain one is the whole."""
        start, low, text = plain_start, self.until["mail_intl"], self.text
        while start > low and (text[start - 1] in _LOCAL or text[start - 1] > "\x7f" and text[start - 1].isalnum()):
            start -= 1
        m = _WIDE_HOST.match(text, at + 1)
        if m and max(low, start) < at and (start, m.end()) != (plain_start, plain_end) and not text[start : m.end()].isascii():
            self.add("mail_intl", max(low, start), m.end())

    def digit(self, at: int, _: int) -> None:
        if at >= self.until["ip"]:
            m = _IP.match(self.text, at)
            if m and all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.groups()):
                self.add("ip", *m.span())
            else:  # a failing match is passed over whole; without one, no start in this run can do
                self.until["ip"] = (m or _RUN.match(self.text, at)).end()
        if at >= self.until["card"]:
            m = _CARD.match(self.text, at)
            self.until["card"] = m.end() if m else at + 1
            if m and m.end() - at >= 16:
                digits = _NOT_DIGIT.sub("", m.group())
                if 16 <= len(digits) <= 19 and luhn(digits):
                    self.add("card", *m.span())

    def plus(self, at: int, _: int) -> None:
        m = _PHONE.match(self.text, at) if at >= self.until["phone"] else None
        if m:
            self.until["phone"] = m.end()
            if 8 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                self.add("phone", *m.span())

    def country(self, at: int, _: int) -> None:
        text = self.text
        if at < self.until["iban"] or at and text[at - 1] in _ALNUM:
            return
        m = _IBAN.match(text, at)
        if m:
            left, end = IBAN[text[at : at + 2]], at
            while left and end < m.end():  # the country says where it ends
                left -= text[end] != " "
                end += 1
            if not left and not (end < len(text) and text[end] in _ALNUM) and iban_ok(text[at:end].replace(" ", "")):
                self.add("iban", at, end)

    def cue(self, at: int, end: int) -> None:
        text = self.text
        if at and text[at - 1].isalnum():
            return
        gap = _GAP.match(text, end, end + CUE_GAP)
        m = _NUMBER.match(text, gap.end())
        if m and gap.end() > end and m.start() >= self.until["account"]:
            if sum(c in "0123456789" for c in m.group()) >= 5:
                self.add("account", *m.span())

    def scheme(self, at: int, end: int) -> None:
        m = _LOGIN.match(self.text, end) if end >= self.until["login"] else None
        if m:
            self.add("login", *m.span())

    def contact(self, at: int, end: int) -> None:
        if at < self.until["contact"] or at and self.text[at - 1] in _ALNUM:
            return
        m = _NAMED.match(self.text, end)
        if m and len(m.group().rstrip(".:")) > 2:
            self.add("contact", at, end + len(m.group().rstrip(".:")))


@lru_cache(1)
def automaton() -> ahocorasick.Automaton:
    """Anchors with their parser and length. Cue words are anchors in small, capital and title letters."""
    made = ahocorasick.Automaton()
    anchors = {"@": Parsers.at_sign, "+": Parsers.plus} | dict.fromkeys("0123456789", Parsers.digit) | dict.fromkeys(IBAN, Parsers.country)
    for words, parser in ((CUES, Parsers.cue), (SCHEMES, Parsers.scheme), (CONTACTS, Parsers.contact)):
        anchors |= {form: parser for w in words for form in (w, w.upper(), w.capitalize(), w.title())}
    for anchor, parser in anchors.items():
        made.add_word(anchor, (parser, len(anchor)))
    made.make_automaton()
    return made


def spans_of(text: str) -> list[tuple[int, int, int]]:
    """Spans (kind, start, end) of a text, by kind as in KINDS, then start."""
    parsers = Parsers(text)
    for last, (parse, n) in automaton().iter(text):
        parse(parsers, last + 1 - n, last + 1)
    return [(k, *span) for k, kind in enumerate(KINDS) for span in parsers.found[kind]]


SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def find(rows: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key of every row and its ``spans``: kind, start, end and the text there."""
    kind = rows.schema[key].dataType
    made = T.StructType().add(key, kind).add("spans", T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("value", "string")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, cols = [0], ([], [], [], [])
            for x in batch.column(1):
                x = x.as_py() or ""
                for k, start, end in spans_of(x):
                    for col, v in zip(cols, (KINDS[k], start, end, x[start:end])):
                        col.append(v)
                at.append(len(cols[0]))
            fields = [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))]
            spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays(fields, ["kind", "start", "end", "value"]))
            yield pa.RecordBatch.from_arrays([batch.column(0), spans], names=[key, "spans"])

    return rows.select(F.col(key), F.col(text)).mapInArrow(run, made)


def redacted(text: str) -> str:
    """The text with each span, or group of overlapping spans, replaced by the kind of its longest one."""
    out, at, group = [], 0, None

    def close():
        nonlocal at
        out.extend((text[at : group[0]], f"[{KINDS[group[2]].upper()}]"))
        at = group[1]

    for start, end, kind in sorted((s, e, k) for k, s, e in spans_of(text)):
        if group and start < group[1]:
            group = (group[0], max(end, group[1]), kind if end - start > group[3] else group[2], max(end - start, group[3]))
            continue
        if group:
            close()
        group = (start, end, kind, end - start)
    if group:
        close()
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """The same rows and columns with personal data replaced; null texts stay null."""
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = pa.array([None if x is None else redacted(x) for x in batch.column(place).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:place], new, *batch.columns[place + 1 :]], names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op13_pii_anchors")
def pii_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    rows = find(table(spark, sf_dir, "documents"))
    only = lambda kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return rows.select(
        "doc_id", *[F.size(only([k])).cast("bigint").alias(f"n_{k}") for k in BASE], F.sha2(_joined(only(BASE)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"), *[F.size(only([k])).cast("bigint").alias(f"n_{k}") for k in KINDS[len(BASE) :]],
    )
