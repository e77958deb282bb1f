"""Quality by co-training of two classifiers with separate views of a document.

The content view reads the text alone: shares of symbols, capitals, digits, repeated words
and lines, and the like. The metadata view reads what is known besides: source, language
and stated length. Both are logistic models. They start from labelled documents; in each
round, each view labels the pool documents it is surest of, in the classes' proportion,
and hands them to the other view, so neither learns from its own guesses. At the end both
are calibrated on labelled documents kept back from training, and a logistic model over
the two calibrated log-odds gives the score of every document.

Learning uses bounded samples, by smallest text hash: at most SAMPLE_LABELLED different
texts of each class and POOL unlabelled ones. Spark computes their features; the driver
gets numbers, no texts. Scoring covers every document.

Defined cases: a null text has the features of an empty one; null source, language and
length are values of their own. Rows without a label are pool rows, rows of the held-out
fold too, without their labels. With one class or none to learn from, every score is the
share of label 1, or 1 where there is no label. Repeated rows get equal rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import held_out, register, table, texts_of
from eventfold.llm.toxicity import logistic

SAMPLE_LABELLED, POOL = 3000, 6000
ROUNDS, PER_ROUND = 5, 200
#: A view hands on a pool document only if it is at least so sure.
SURE = 0.9
#: Every fourth labelled text is kept back for calibration.
KEPT_BACK = 4
HASHED = 32
CONTENT = 14

_UPPER, _DIGIT, _SIGN = bytes(range(65, 91)), bytes(range(48, 58)), b"#*$%&|<>"
_PUNCT, _LETTER = b".,;:!?", bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def content(text: bytes) -> list[float]:
    """The content view of a text."""
    n = max(len(text), 1)
    share = lambda signs: (len(text) - len(text.translate(None, signs))) / n
    words, lines = text.split(), [x for x in text.split(b"\n") if x.strip()]
    w, k = max(len(words), 1), max(len(lines), 1)
    letters = share(_LETTER)
    return [
        np.log1p(len(words)) / 5, sum(map(len, words)) / w / 10, 10 * share(_SIGN), 10 * share(b"!"), share(_UPPER) / max(letters, 1 / n),
        10 * share(_DIGIT), letters, 10 * share(_PUNCT), len(set(words)) / w, sum(a == b for a, b in zip(words, words[1:])) / w,
        1 - len(set(lines)) / k, np.log1p(len(lines)) / 5, np.log1p(n / k) / 5, float(not words),
    ]


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """The metadata view: hashed source and language, stated length."""
    out = [0.0] * (HASHED + 3)
    out[xxhash.xxh32_intdigest(f"source={source}") % HASHED] += 1
    out[xxhash.xxh32_intdigest(f"lang={lang}") % HASHED] += 1
    out[HASHED] = np.log1p(max(n_chars or 0, 0)) / 10
    out[HASHED + 1] = out[HASHED] ** 2
    out[HASHED + 2] = float(n_chars is None)
    return out


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    at = batch.schema.get_field_index
    rows = zip(*(batch.column(at(c)).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)
    a = np.array([content(t) for t in texts_of(batch, "text")], float).reshape(-1, CONTENT)
    return a, np.array([metadata(*r) for r in rows], float).reshape(-1, HASHED + 3)


def log_odds(x: np.ndarray, b: np.ndarray) -> np.ndarray:
    return b[0] + x @ b[1:]


def sure(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    """Coefficients of both views, their calibrations (shift, slope), and of the combination."""

    content: np.ndarray
    metadata: np.ndarray
    calibration: np.ndarray
    combination: np.ndarray

    def scores(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined score, content score, metadata score."""
        za = self.calibration[0, 0] + self.calibration[0, 1] * log_odds(a, self.content)
        zb = self.calibration[1, 0] + self.calibration[1, 1] * log_odds(b, self.metadata)
        return sure(log_odds(np.c_[za, zb], self.combination)), sure(za), sure(zb)


def constant(share: float) -> Model:
    z = float(np.log((share + 1e-6) / (1 - share + 1e-6)))
    return Model(np.zeros(CONTENT + 1), np.zeros(HASHED + 4), np.zeros((2, 2)), np.array([z, 0.0, 0.0]))


def co_train(xs: tuple[np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray, pool: tuple[np.ndarray, np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """Coefficients of both views after the exchange of confident pseudo-labels."""
    share = float((y * weight).sum() / weight.sum())
    given = [np.full(len(pool[0]), -1), np.full(len(pool[0]), -1)]  # pseudo-labels that each view got from the other

    def fit(v):
        have = given[v] >= 0
        return logistic(np.r_[xs[v], pool[v][have]], np.r_[y, given[v][have]], np.r_[weight, np.full(have.sum(), 0.5)], ridge=1.0)

    models = [fit(0), fit(1)]
    for _ in range(rounds):
        for v in (0, 1):
            p = sure(log_odds(pool[v], models[v]))
            for label, want in ((1, round(PER_ROUND * share)), (0, round(PER_ROUND * (1 - share)))):
                trust = p if label else 1 - p
                trust = np.where(given[1 - v] < 0, trust, 0)
                best = np.argsort(-trust, kind="stable")[:want]
                given[1 - v][best[trust[best] >= SURE]] = label
        models = [fit(0), fit(1)]
    return models


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Sample, co-train, calibrate and combine."""
    keys = docs.select("doc_id", F.xxhash64("text").alias("h"), held_out(F.col("doc_id")).alias("out"))
    known = labels.select("doc_id", "quality").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    marked = keys.join(known, "doc_id", "left").withColumn("y", F.when(~F.col("out"), F.col("quality")))
    each = marked.groupBy("h").agg(F.max("y").alias("y"), F.min("doc_id").alias("doc_id"))
    share = {r.y: r["count"] for r in each.where("y is not null").groupBy("y").count().collect()}
    if not share.get(0) or not share.get(1):
        return constant(1.0 if not share or share.get(1) else 0.0)
    parts = [each.where(c).orderBy("h").limit(n) for c, n in (("y = 1", SAMPLE_LABELLED), ("y = 0", SAMPLE_LABELLED), ("y is null", POOL))]
    ids = F.broadcast(parts[0].union(parts[1]).union(parts[2]))
    columns = [F.col(c) for c in ("text", "lang", "source", "n_chars")]
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), *columns).join(ids, ["doc_id", "h"]).dropDuplicates(["h"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = views(batch)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(a), pa.list_(pa.float64())), pa.array(list(b), pa.list_(pa.float64()))], names=["h", "y", "a", "b"])

    got = rows.select("h", "y", *columns).mapInArrow(read, "h bigint, y int, a array<double>, b array<double>").orderBy("h").toPandas()
    a, b = np.stack(got.a.to_numpy()), np.stack(got.b.to_numpy())
    y = got.y.to_numpy(float, na_value=np.nan)
    is_pool = np.isnan(y)
    back = ~is_pool & ((got.h.to_numpy(np.int64) >> 3) % KEPT_BACK == 0)
    for label in (0, 1):  # small samples: both parts need both classes
        own = np.flatnonzero(y == label)
        if not back[own].any() or back[own].all():
            back[own] = np.arange(len(own)) % 2 == 1
            back[own] |= len(own) == 1
    train = ~is_pool & (~back | np.isin(y, [v for v in (0, 1) if (y == v).sum() == 1]))
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    weight *= (~is_pool).sum() / (share[0] + share[1])
    models = co_train((a[train], b[train]), y[train], weight[train], (a[is_pool], b[is_pool]))
    z = np.c_[log_odds(a[back], models[0]), log_odds(b[back], models[1])]
    calibration = np.stack([logistic(z[:, [v]], y[back], weight[back], ridge=0.1) for v in (0, 1)])
    calibrated = calibration[:, 0] + z * calibration[:, 1]
    return Model(*models, calibration, logistic(calibrated, y[back], weight[back], ridge=0.1))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, content_score, metadata_score), one per document row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.scores(*views(batch))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, found)], names=["doc_id", "score", "content_score", "metadata_score"])

    return docs.select("doc_id", "text", "lang", "source", "n_chars").mapInArrow(run, f"doc_id {kind}, score double, content_score double, metadata_score double")


@register("op1_cotraining_quality")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
        (F.col("score") >= 0.5).alias("kept"), "content_score", "metadata_score",
    )
