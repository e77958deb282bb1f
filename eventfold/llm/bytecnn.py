"""Language identification by a byte convolutional network, trained here in numpy.

A text is cut into fixed-length windows of UTF-8 bytes. Filters of several widths slide
over a window, each keeps its largest response (max pooling after a rectifier), and a
softmax over the pooled features gives the languages. A document's prediction is the mean
over all its windows, weighted by their bytes: whole texts, never prefixes.

Filters read embedded bytes. As there are only 256 bytes, embedding and filter weights
fold into one table per place, and two neighbouring places into one table of byte pairs,
so a window is read by table look-ups.

The network learns from at most SAMPLE_TEXTS different texts per language, by smallest
text hash, and SAMPLE_WINDOWS windows of each; nothing else is sampled.

Defined cases: null texts and texts without a letter get ``und`` and score 0. With one
known language every other text gets it, with none ``und``. Rows with a null language are
not learned from. Repeated rows get equal rows. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.base import held_out, register, table, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_TEXTS, SAMPLE_WINDOWS = 800, 3
EPOCHS, RATE = 8, 0.01
UNKNOWN = "und"
REACH = max(WIDTHS)


def windows(text: bytes) -> np.ndarray:
    """Rows of WINDOW bytes; the last one is filled up with zero bytes."""
    n = max(1, -(-len(text) // WINDOW))
    out = np.zeros(n * WINDOW, np.uint8)
    out[: len(text)] = np.frombuffer(text, np.uint8)
    return out.reshape(n, WINDOW)


class Network:
    """Parameters: byte embedding, filters per width, biases, softmax weights."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        total = FILTERS * len(WIDTHS)
        self.embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
        # places beyond a filter's width stay zero
        self.mask = np.concatenate([np.repeat((np.arange(REACH) < w)[:, None], FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)
        self.filters = (rng.normal(0, 0.3, (REACH, EMBED, total)) * self.mask[:, None]).astype(np.float32)
        self.bias = np.zeros(total, np.float32)
        self.out = rng.normal(0, 0.1, (total, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.bias, self.out, self.out_bias]

    def responses(self, rows: np.ndarray) -> np.ndarray:
        """Filter responses (windows, places, filters) before pooling."""
        tables = np.einsum("be,jef->jbf", self.embed, self.filters)
        last = rows.shape[1] - REACH + 1
        return sum(tables[j][rows[:, j : j + last]] for j in range(REACH)) + self.bias

    def step(self, rows: np.ndarray, label: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Gradients of the mean cross-entropy, and its value."""
        n = len(rows)
        found = self.responses(rows)
        place = found.argmax(1)
        pooled = np.take_along_axis(found, place[:, None], 1)[:, 0]
        feature = np.maximum(pooled, 0)
        p = softmax(feature @ self.out + self.out_bias)
        loss = -np.log(p[np.arange(n), label] + 1e-12).mean()
        p[np.arange(n), label] -= 1
        p /= n
        back = (p @ self.out.T) * (pooled > 0)  # only the largest response of each filter passes it on
        g_embed, g_filters = np.zeros_like(self.embed), np.zeros_like(self.filters)
        for j in range(REACH):
            read = np.take_along_axis(rows, place + j, 1)  # byte under place j of each filter's best response
            g_filters[j] = np.einsum("nfe,nf->ef", self.embed[read], back) * self.mask[j]
            np.add.at(g_embed, read, back[:, :, None] * self.filters[j].T[None])
        return [g_embed, g_filters, back.sum(0), feature.T @ p, p.sum(0)], float(loss)

    def train(self, rows: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 3) -> None:
        """Adam over shuffled batches; the rate falls to zero."""
        rng, size, t = np.random.default_rng(seed), 64, 0
        total = epochs * -(-len(rows) // size)
        first = [np.zeros_like(x) for x in self.parameters()]
        second = [np.zeros_like(x) for x in self.parameters()]
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), size):
                take = order[at : at + size]
                grads, _ = self.step(rows[take], label[take])
                t += 1
                rate = RATE * (1 - (t - 1) / total)
                for x, g, m, v in zip(self.parameters(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def folded(self) -> list[np.ndarray]:
        """A table of responses for each pair of neighbouring places, by the two bytes."""
        tables = np.einsum("be,jef->jbf", self.embed, self.filters)
        return [(tables[j][:, None] + tables[j + 1][None]).reshape(1 << 16, -1) for j in range(0, REACH, 2)]


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Reader:
    """Applies a trained network to many windows."""

    def __init__(self, net: Network):
        self.net, self.pairs = net, net.folded()

    def probabilities(self, rows: np.ndarray) -> np.ndarray:
        out = np.empty((len(rows), len(self.net.languages)), np.float32)
        last = WINDOW - REACH + 1
        for at in range(0, len(rows), 16):  # few windows at once stay in the cache
            part = rows[at : at + 16]
            pair = (part[:, :-1].astype(np.intp) << 8) | part[:, 1:]
            found = self.pairs[0].take(pair[:, :last], 0)
            for k, own in enumerate(self.pairs[1:], 1):
                found += own.take(pair[:, 2 * k : 2 * k + last], 0)
            feature = np.maximum(found.max(1) + self.net.bias, 0)
            out[at : at + len(part)] = softmax(feature @ self.net.out + self.net.out_bias)
        return out


def sample(docs: DataFrame) -> DataFrame:
    """Texts to learn from, at most SAMPLE_TEXTS per language, with their language."""
    known = docs.where(~held_out(F.col("doc_id"))).where("lang is not null and text is not null").select("lang", F.xxhash64("text").alias("h"), "doc_id")
    each = known.groupBy("lang", "h").agg(F.min("doc_id").alias("doc_id"))
    # the smallest hashes of a language, found by a threshold on counts of hash ranges: no language is sorted whole
    cells = each.groupBy("lang", F.shiftrightunsigned("h", 48).alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    upto = cells.withColumn("before", F.sum("n").over(Window.partitionBy("lang").orderBy("cell")) - F.col("n"))
    limits = upto.where(F.col("before") < SAMPLE_TEXTS).groupBy("lang").agg(F.max("cell").alias("limit"))
    near = each.join(F.broadcast(limits), "lang").where(F.shiftrightunsigned("h", 48) <= F.col("limit"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 48), "h"))
    picked = near.withColumn("rank", rank).where(F.col("rank") <= SAMPLE_TEXTS).select("doc_id", "h", F.col("lang").alias("label"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(F.broadcast(picked), ["doc_id", "h"])
    return rows.select("label", "h", "text")


def training_windows(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, windows and labels. The windows of a text are spread over its length."""

    def cut(batches):
        for batch in batches:
            label, window = [], []
            for lang, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                rows = windows(text)
                if len(rows) > 1:
                    rows = rows[: len(text) // WINDOW]
                for i in np.unique(np.linspace(0, len(rows) - 1, SAMPLE_WINDOWS).astype(int)):
                    label.append(lang)
                    window.append(rows[i].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(label, pa.string()), pa.array(window, pa.binary())], names=["label", "window"])

    got = sorted({(r.label, bytes(r.window)) for r in sample(docs).mapInArrow(cut, "label string, window binary").collect()})
    names = sorted({x for x, _ in got})
    rows = np.frombuffer(b"".join(w for _, w in got), np.uint8).reshape(-1, WINDOW)
    return names, rows, np.array([names.index(x) for x, _ in got], np.int64)


def fit(docs: DataFrame) -> Network | None:
    """A network for the languages of the learnable rows; None where there is none."""
    names, rows, label = training_windows(docs)
    if not names:
        return None
    net = Network(names)
    if len(names) > 1:
        net.train(rows, label)
    return net


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Rows (doc_id, lang_pred, score, n_windows), one per document row."""
    kind = dict(docs.dtypes)["doc_id"]
    lettered = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(net) if net else None
        for batch in batches:
            texts = [t if ok and net else b"" for t, ok in zip(texts_of(batch, "text"), batch.column(2).to_pylist(), strict=True)]
            lang, score, count = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
            some = [i for i, t in enumerate(texts) if t]
            if some:
                cut = [windows(texts[i]) for i in some]
                sizes = np.array([len(x) for x in cut])
                starts = np.cumsum(sizes) - sizes
                weight = np.full(sizes.sum(), float(WINDOW))
                weight[starts + sizes - 1] = [(len(texts[i]) - 1) % WINDOW + 1 for i in some]
                p = reader.probabilities(np.concatenate(cut)) * weight[:, None]
                mean = np.add.reduceat(p, starts, 0) / np.add.reduceat(weight, starts)[:, None]
                for i, k, best in zip(some, mean.argmax(1), mean.max(1), strict=True):
                    lang[i], score[i] = net.languages[k], min(float(best), 1.0)
                count[some] = sizes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang), pa.array(score), pa.array(count)], names=["doc_id", "lang_pred", "score", "n_windows"])

    return docs.select("doc_id", "text", lettered.alias("ok")).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, n_windows bigint")


@register("op9_byte_cnn_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "n_windows")
