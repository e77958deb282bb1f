"""Secret scans with DataFrame functions only.

Three kinds are found by pattern: assignments, access keys and long hexadecimal runs.
Further candidates, runs of key characters with a digit, are judged by Shannon entropy
over a sliding window: the counts of the window's characters change by one in and one out
at each step, and the sum of ``c * log2(c)`` changes by four table values, so no window is
counted again. The largest window entropy is held against the threshold of the candidate's
character class, unless an allow-list pattern names the candidate or a pattern kind
already covers part of it.

Places come from splitting a text at the matches: lengths of the parts between them and of
the matches add up to code point offsets.

Defined cases: a null text is an empty one; texts without a finding have empty lists.
Everything stays within a row, so repeated rows get equal rows and an empty table none.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import register, table

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z+/_-]*+[0-9][A-Za-z0-9+/_-]*={0,2}"
WINDOW = 20
#: Least window entropy in bits by character class; a window of 20 has 4.32 at most.
THRESHOLDS = (("hex", r"^[0-9a-fA-F]+$", 3.0), ("alnum", r"^[0-9A-Za-z]+$", 3.6), ("base64", "", 3.8))
#: Candidates that are known not to be secrets.
ALLOW = (
    r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$",  # UUID
    r"^[0-9_/+-]+$",  # numbers and dates
    r"EXAMPLE|example|0123456789|abcdefgh",
    r"^[A-Za-z]+([/_-]+[A-Za-z]*)*[0-9]{1,4}$",  # words with a number behind
)


def _empty() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int>>")


def _spans(text: str, pattern: str, kind: int, when: Column, value: int | None = None) -> Column:
    """Places of all matches; with ``value``, only where that group has six characters."""
    rx = F.lit(pattern)
    found, parts = F.regexp_extract_all(text, rx, F.lit(0)), F.split(text, pattern, -1)
    group = F.regexp_extract_all(text, rx, F.lit(value)) if value else found
    # the last part has no match behind it
    rows = F.zip_with(F.zip_with(parts, found, lambda p, m: F.struct(F.length(p).alias("gap"), F.length(m).alias("n"))), group, lambda x, g: F.struct(x["gap"].alias("gap"), x["n"].alias("n"), F.length(g).alias("g")))
    return F.when(
        when,
        F.aggregate(
            rows,
            F.struct(F.lit(0).alias("at"), _empty().alias("out")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + F.coalesce(x["n"], F.lit(0))).alias("at"),
                F.when(
                    x["n"].isNotNull() & ((x["g"] >= 6) if value else F.lit(True)),
                    F.array_append(a["out"], F.struct((a["at"] + x["gap"]).alias("start"), F.lit(kind).alias("kind"), (a["at"] + x["gap"] + x["n"]).alias("end"))),
                ).otherwise(a["out"]).alias("out"),
            ),
            lambda a: a["out"],
        ),
    ).otherwise(_empty())


def window_entropy(text: Column, width: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any ``width`` consecutive characters of an ASCII column."""
    weigh = F.array(*[F.lit(0.0)], *[F.lit(c * math.log2(c)) for c in range(1, width + 2)])
    cost = lambda c: F.element_at(weigh, c + 1)
    chars = F.regexp_extract_all(text, F.lit("."), F.lit(0))
    letters = F.array_distinct(chars)
    codes = F.transform(chars, lambda c: F.array_position(letters, c).cast("int"))
    first = F.transform(letters, lambda x: F.size(F.filter(F.slice(chars, 1, width), lambda c: c == x)))
    start = F.struct(
        first.alias("counts"),
        F.aggregate(first, F.lit(0.0), lambda a, c: a + cost(c)).alias("sum"),
        F.aggregate(first, F.lit(0.0), lambda a, c: a + cost(c)).alias("least"),
    )
    # pairs (character that comes in, character that goes out)
    moves = F.zip_with(F.slice(codes, width + 1, F.greatest(F.size(codes), F.lit(1))), codes, lambda i, o: F.struct(i.alias("i"), o.alias("o")))

    def step(a: Column, x: Column) -> Column:
        came, went = F.element_at(a["counts"], x["i"]), F.element_at(a["counts"], x["o"])
        moved = a["sum"] - cost(came) - cost(went) + cost(came + 1) + cost(went - 1)
        still = x["i"].isNull() | (x["i"] == x["o"])
        total = F.when(still, a["sum"]).otherwise(moved)
        counts = F.when(still, a["counts"]).otherwise(
            F.transform(a["counts"], lambda c, k: c + F.when(k + 1 == x["i"], 1).when(k + 1 == x["o"], -1).otherwise(0))
        )
        return F.struct(counts.alias("counts"), total.alias("sum"), F.least(a["least"], total).alias("least"))

    least = F.aggregate(moves, start, step, lambda a: a["least"])
    return math.log2(width) - least / width


def _judged(cut: Column) -> Column:
    """Whether a candidate's entropy passes its class and no allow-list pattern names it."""
    bits = window_entropy(cut)
    limit = F.when(cut.rlike(THRESHOLDS[0][1]), THRESHOLDS[0][2]).when(cut.rlike(THRESHOLDS[1][1]), THRESHOLDS[1][2]).otherwise(THRESHOLDS[2][2])
    allowed = F.lit(False)
    for pattern in ALLOW:
        allowed = allowed | cut.rlike(pattern)
    return F.when(allowed, F.lit(False)).otherwise(bits >= limit)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' ids with ``base`` and ``found``: arrays of (start, kind, end), sorted."""
    low = F.lower("t")
    keyed = F.lit(False)
    for word in KEYWORDS:
        keyed = keyed | low.contains(word)
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = rows.select(
        "doc_id", "t",
        _spans("t", ASSIGN, 0, keyed, value=1).alias("assign"), _spans("t", ACCESS, 1, F.col("t").contains("AKIA")).alias("access"),
        _spans("t", HEX, 2, F.col("t").rlike(HEX)).alias("hex"),
        _spans("t", CANDIDATE, 3, F.col("t").rlike(r"[0-9]")).alias("candidates"),
    )
    rows = rows.select("doc_id", "t", "assign", "access", "hex", F.array_sort(F.concat("assign", "access", "hex")).alias("base"), F.filter("candidates", lambda c: c["end"] - c["start"] >= WINDOW).alias("candidates"))
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("free", free)
    judged = F.filter("free", lambda c: _judged(F.substring("t", c["start"] + 1, c["end"] - c["start"])))
    found = F.when(F.size("free") > 0, judged).otherwise(_empty())
    return rows.select("doc_id", "assign", "access", "hex", "base", found.alias("entropy"))


def _text(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


@register("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    rows = scan(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_text(F.col("base")), 256).alias("base_sha256"), _text(F.array_sort(F.concat("base", "entropy"))).alias("spans"),
        F.size("entropy").cast("bigint").alias("n_entropy"),
    )
