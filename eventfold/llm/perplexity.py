"""Quality rules: simple text measures, and perplexity bands of an n-gram model per language.

The model is an interpolated modified Kneser-Ney model of ORDER consecutive characters.
Characters rather than words, so that what a task holds stays small however large the
corpus is; every document is counted. Tasks count their texts, Spark adds the counts up
and derives continuation counts, discounts and probabilities by grouping and joining. A
gram is packed into 64 bits, so its key is exact. For scoring, keys are mixed and kept in
a sorted array with an index over their leading bits. Up to MODEL_ROWS grams the arrays
are broadcast; beyond that the same scores come from joining gram counts to the model.

A document's perplexity is taken under its own language's model. Beside it stands a word
perplexity: words counted in two folds of the texts (equal texts share a fold), each text
scored by the other fold, so never by its own counts. Up to HEAD frequent words are broadcast;
all other words are joined to the texts that hold them, so the driver's share is bounded.

Both are measured from their language's median, in ``sqrt((q3 - q1)^2 + NOISE^2 / length)``
of the documents that pass the base rules (quartiles exact to 0.001; a mean over few signs is
noisy). The permitted ranges are set on labelled documents outside the held-out fold: where
rejected bad ones pay best, a good one lost counting COST times. Without labels of both kinds
they reach FENCE to both sides.

Defined cases: a null text has no words and fails the base rules. A null language is a
language of its own. Characters beyond the basic plane count as one sign in the model.
A language with words in one
fold only has no word perplexity, which rejects nothing. Repeated rows get equal rows. An
empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventfold.llm.base import held_out, register, table, texts_of, written

ORDER = 3
MODEL_ROWS = 4_000_000
FENCE = 8.0
#: Noise of one word's and one character's log probability, in the scores' own units.
WORD_NOISE, CHAR_NOISE = 3.0, 1.5
#: Share of the good texts lost against share of the bad ones rejected, when ranges are set.
COST = 20
#: Frequent words that tasks hold; the others are joined.
HEAD = 500_000
WORD_DISCOUNT = 0.75
#: Characters counted or looked up at once.
CHUNK = 1 << 20
MIX = 0x9E3779B97F4A7C15
_SPACE, _MORE, _SIGNS = b" \t\n\x0b\x0c\r", bytes(range(0x80, 0xC0)), b"#*$%&|<>"

BASE = "n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint"


def measures(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, characters in words, symbols, repeated lines, words in repeated windows of three."""
    words = text.split()
    chars = len(text.translate(None, _SPACE + _MORE))
    symbols = len(text) - len(text.translate(None, _SIGNS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated, windows = 0, list(zip(words, words[1:], words[2:]))
    if len(set(windows)) < len(windows):
        seen: dict[tuple, int] = {}
        names = np.array([seen.setdefault(w, len(seen)) for w in windows])
        twice = np.flatnonzero(np.bincount(names)[names] > 1)
        hit = np.zeros(len(words), bool)
        for k in range(3):
            hit[twice + k] = True
        repeated = int(hit.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def grams(texts: list[bytes]) -> np.ndarray:
    """Packed grams that end at each character of the texts; texts start from zeros."""
    pad = "\0" * (ORDER - 1)
    codes = np.frombuffer((pad + pad.join(t.decode() for t in texts)).encode("utf-32-le"), np.uint32)
    codes = np.minimum(codes, 0xFFFF).astype(np.uint64)
    out = codes.copy()
    for k in range(1, ORDER):
        out[k:] |= codes[:-k] << np.uint64(16 * k)
    keep = np.ones(len(codes), bool)
    at = 0
    for t in texts:  # the padding itself is not a character
        keep[at : at + ORDER - 1] = False
        at += ORDER - 1 + len(t.translate(None, _MORE))
    return out[keep]


def chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and texts, about CHUNK bytes at a time."""
    rows, own, size = [], [], 0
    for i, t in enumerate(texts):
        rows.append(i)
        own.append(t)
        size += len(t) + ORDER
        if size >= CHUNK:
            yield rows, own
            rows, own, size = [], [], 0
    if rows:
        yield rows, own


def by_language(batch: pa.RecordBatch) -> dict[str, tuple[list[int], list[bytes]]]:
    out: dict[str, tuple[list[int], list[bytes]]] = {}
    for i, (lang, text) in enumerate(zip(batch.column(batch.schema.get_field_index("lang")).to_pylist(), texts_of(batch, "text"), strict=True)):
        if text:
            rows, own = out.setdefault(lang or "", ([], []))
            rows.append(i)
            own.append(text)
    return out


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, at = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in parts]), len(keys)).astype(np.int64)


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows (lang, gram, n) over all documents."""

    def run(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for lang, (_, texts) in by_language(batch).items():
                held = total.setdefault(lang, [])
                held += [np.unique(grams(own), return_counts=True) for _, own in chunks(texts)]
                if sum(len(k) for k, _ in held) > 1 << 21:
                    total[lang] = [_added(held)]
        for lang, held in total.items():
            keys, n = _added(held)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, gram bigint, n bigint")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _low(gram: str, order: int) -> Column:
    """The last ``order`` characters of a packed gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * order) - 1))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """Rows (lang, gram, logp): natural log probability of each seen gram's last character.

    ``counts`` is read several times and should be a written table.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):  # how many different characters stand before the shorter gram
        levels[k] = written(levels[k + 1].groupBy("lang", _low("gram", k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"kn-{k}")
    lower = None
    for k in range(1, ORDER + 1):
        rows = levels[k]
        times = rows.groupBy("lang").agg(*[F.sum((F.col("n") == i).cast("double")).alias(f"t{i}") for i in range(1, 5)], F.count(F.lit(1)).alias("kinds"))
        y = F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2"))
        d = [F.greatest(F.lit(0.05), F.least(F.coalesce(i - F.try_divide((i + 1) * y * F.col(f"t{i + 1}"), F.col(f"t{i}")), F.lit(0.5 * i)), F.lit(i - 0.05))) for i in (1, 2, 3)]
        rows = rows.join(F.broadcast(times.select("lang", "kinds", *[x.alias(f"d{i}") for i, x in enumerate(d, 1)])), "lang")
        rows = rows.withColumn("d", F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3")))
        context = F.shiftrightunsigned("gram", 16).alias("context")
        before = rows.groupBy("lang", context).agg(F.sum("n").alias("total"), F.sum("d").alias("spread"))
        rows = rows.select("lang", "gram", "n", "d", "kinds", context).join(before, ["lang", "context"])
        own, left = (F.col("n") - F.col("d")) / F.col("total"), F.col("spread") / F.col("total")
        if k == 1:
            lower = rows.select("lang", "gram", (own + left / (F.col("kinds") + 1)).alias("p"))
        else:
            short = lower.select("lang", F.col("gram").alias("suffix"), F.col("p").alias("q"))
            rows = rows.withColumn("suffix", _low("gram", k - 1)).join(short, ["lang", "suffix"])
            lower = rows.select("lang", "gram", (own + left * F.col("q")).alias("p"))
        lower = written(lower, f"kn-p{k}")
    return lower.select("lang", "gram", F.log("p").alias("logp"))


class Arrays:
    """Sorted mixed keys of one language with their values, and an index over leading bits."""

    def __init__(self, grams_: np.ndarray, values: np.ndarray):
        keys = grams_.view(np.uint64) * np.uint64(MIX)
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order].astype(np.float32)
        self.shift = np.uint64(64 - max(1, min(24, int(len(keys)).bit_length())))
        parts = np.arange(1 << int(np.uint64(64) - self.shift), dtype=np.uint64) << self.shift
        self.start = np.searchsorted(self.keys, parts).astype(np.int64)

    def find(self, grams_: np.ndarray) -> np.ndarray:
        """Values of grams that are all in the model."""
        keys = grams_ * np.uint64(MIX)
        at = self.start[(keys >> self.shift).astype(np.int64)]
        open_ = np.flatnonzero(self.keys[at] < keys)
        while len(open_):
            at[open_] += 1
            open_ = open_[self.keys[at[open_]] < keys[open_]]
        if not np.array_equal(self.keys[at], keys):
            raise ValueError("a gram of the scored text is not in the model")
        return self.values[at]


def _measured(docs: DataFrame, models: dict[str, Arrays] | None) -> DataFrame:
    """Rows (doc_id, part, lang, measures, chars, total): total log probability where models are given."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(models)
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            base = [measures(t) for t in texts_of(batch, "text")]
            chars, total = np.zeros(len(base), np.int64), np.zeros(len(base))
            for lang, (rows, texts) in by_language(batch).items():
                for part, own in chunks(texts):
                    sizes = np.array([len(t.translate(None, _MORE)) for t in own])
                    at = np.array(rows)[part]
                    chars[at] = sizes
                    if shared.value is not None:
                        found = shared.value[lang].find(grams(own)).astype(np.float64)
                        total[at] = np.add.reduceat(found, np.cumsum(sizes) - sizes)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), *(pa.array(c, pa.int64()) for c in zip(*base)), pa.array(chars), pa.array(total)],
                names=["doc_id", "part", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "total"],
            ) if base else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SCORED], schema=_SCORED)

    keyed = docs.select("doc_id", F.xxhash64("text", "lang").alias("part"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    return keyed.mapInArrow(run, f"doc_id {kind}, part bigint, lang string, {BASE}, chars bigint, total double")


_SCORED = pa.schema(
    [("doc_id", pa.int64()), ("part", pa.int64()), ("lang", pa.string())]
    + [(x.split()[0], pa.int64()) for x in BASE.split(", ")] + [("chars", pa.int64()), ("total", pa.float64())]
)


def _joined(docs: DataFrame, model: DataFrame) -> DataFrame:
    """The same without a broadcast: gram counts of each document joined to the model."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        for batch in batches:
            for i, (lang, text) in enumerate(zip(batch.column(2).to_pylist(), texts_of(batch, "text"), strict=True)):
                if text:
                    keys, n = np.unique(grams([text]), return_counts=True)
                    take = pa.array(np.full(len(keys), i))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([lang] * len(keys)), pa.array(keys.view(np.int64)), pa.array(n)], names=["doc_id", "part", "lang", "gram", "n"])

    keyed = docs.select("doc_id", F.xxhash64("text", "lang").alias("part"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    own = keyed.mapInArrow(run, f"doc_id {kind}, part bigint, lang string, gram bigint, n bigint").distinct()
    sums = own.join(model, ["lang", "gram"]).groupBy("doc_id", "part").agg(F.sum(F.col("n") * F.col("logp").cast("float")).alias("total"))
    right = sums.select(F.col("doc_id").alias("d"), F.col("part").alias("p"), F.col("total").alias("sum"))
    rows = _measured(docs, None)
    return rows.join(right, (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("d")), "left").select(
        *[F.coalesce("sum", F.lit(0.0)).alias(c) if c == "total" else F.col(c) for c in rows.columns]
    )


def scored(docs: DataFrame, model_rows: int = MODEL_ROWS) -> DataFrame:
    """Measures and log perplexity (null for empty texts) of every document row."""
    model = kneser_ney(written(gram_counts(docs), "kn-counts"))
    if model.count() > model_rows:
        rows = _joined(docs, model)
    else:
        models = {}
        for lang in sorted(r.lang for r in model.select("lang").distinct().collect()):
            own = model.where(F.col("lang") == lang).select("gram", F.col("logp").cast("float").alias("logp")).toArrow()
            models[lang] = Arrays(own.column(0).to_numpy(), own.column(1).to_numpy())
        rows = _measured(docs, models)
    rows = written(rows, "kn-scored")
    return rows.withColumn("log_perplexity", F.when(F.col("chars") > 0, -F.col("total") / F.col("chars")))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _fold(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) & 1


def _word_keys(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes that name a word of a language."""
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], np.uint64).view(np.int64)


def word_model(docs: DataFrame) -> DataFrame:
    """Rows (word, often, logp0, logp1): how often a word occurs, and what it costs a text of fold 0 and 1.

    The counts of the other fold are smoothed by absolute discounting.
    """

    def run(batches):
        held: dict[tuple[str, int], Counter] = {}

        def rows():
            for (lang, fold), n in held.items():
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(n), pa.string()), pa.array([fold] * len(n), pa.int32()), pa.array(_word_keys(lang, list(n))), pa.array(list(n.values()), pa.int64())],
                    names=["lang", "fold", "word", "n"],
                )

        for batch in batches:
            for lang, (_, texts) in by_language(batch).items():
                for text in texts:
                    held.setdefault((lang, _fold(text)), Counter()).update(text.split())
            if sum(map(len, held.values())) > 1 << 20:
                yield from rows()
                held = {}
        yield from rows()

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, fold int, word bigint, n bigint")
    each = [F.sum(F.when(F.col("fold") == f, F.col("n")).otherwise(0)).alias(f"n{f}") for f in (0, 1)]
    counts = written(rows.groupBy("lang", "word").agg(*each), "words-counts")
    sizes = counts.groupBy("lang").agg(
        *[F.sum(f"n{f}").cast("double").alias(f"t{f}") for f in (0, 1)], *[F.count(F.when(F.col(f"n{f}") > 0, 1)).alias(f"k{f}") for f in (0, 1)]
    )

    def logp(f):
        free = WORD_DISCOUNT * F.col(f"k{f}") / (F.col(f"k{f}") + 1)
        return F.log(F.try_divide(F.greatest(F.col(f"n{f}") - WORD_DISCOUNT, F.lit(0.0)) + free, F.col(f"t{f}")))

    return counts.join(F.broadcast(sizes), "lang").select("word", (F.col("n0") + F.col("n1")).alias("often"), logp(1).alias("logp0"), logp(0).alias("logp1"))


def word_scores(docs: DataFrame, head: int = HEAD) -> DataFrame:
    """Rows (key, word_total): log probability of each different document's words by the other fold.

    The key is a hash of id, text and language.
    """
    model = word_model(docs)
    top = model.orderBy(F.desc("often"), "word").limit(head).toArrow()
    order = np.argsort(top.column("word").to_numpy())
    keys, values = top.column("word").to_numpy()[order], np.stack([top.column(f"logp{f}").to_numpy()[order].astype(float) for f in (0, 1)])
    del top
    shared = docs.sparkSession.sparkContext.broadcast((keys, values))

    def run(batches):
        keys, values = shared.value
        for batch in batches:
            take, word, n, total = [], [], [], []
            for i, (lang, text) in enumerate(zip(batch.column(1).to_pylist(), texts_of(batch, "text"), strict=True)):
                own = Counter(text.split())
                hashes, times = _word_keys(lang, list(own)), np.array(list(own.values()), np.int64)
                at = np.minimum(np.searchsorted(keys, hashes), max(len(keys) - 1, 0))
                known = keys[at] == hashes if len(keys) else np.zeros(len(hashes), bool)
                f, rare = _fold(text), ~known
                take.append(np.full(rare.sum() + 1, i))
                word += [[i], hashes[rare]]  # the first row is the document's own and joins nothing
                n += [[0], 2 * times[rare] + f]
                total += [[float((values[f][at[known]] * times[known]).sum())], np.zeros(rare.sum())]
            take, word, n, total = (np.concatenate([np.zeros(0, t), *x]).astype(t) for x, t in ((take, int), (word, int), (n, int), (total, float)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(take)), pa.array(word), pa.array(n), pa.array(total, mask=n > 0)], names=["key", "word", "n", "total"])

    keyed = docs.select(document_key().alias("key"), F.coalesce("lang", F.lit("")).alias("lang"), "text")
    rows = keyed.mapInArrow(run, "key bigint, word bigint, n bigint, total double").join(model, "word", "left")
    rare = F.expr("n div 2") * F.when(F.col("n") % 2 == 0, F.col("logp0")).otherwise(F.col("logp1"))
    own = F.col("n") == 0
    # repeated rows come with all their words, so the sum is a multiple
    return rows.groupBy("key").agg((F.sum(F.when(own, F.col("total")).otherwise(rare)) / F.count(F.when(own, 1))).alias("word_total"))


def document_key() -> Column:
    return F.xxhash64("doc_id", F.xxhash64("text", "lang"))


def centred(rows: DataFrame, score: str, length: str, noise: float) -> DataFrame:
    """``rows`` with column ``z_<score>``: the distance from the language's median in its own spread."""
    cells = rows.where(~base_failed()).where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy("lang", F.round(F.col(score) * 1000).cast("bigint").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.partitionBy("lang")
    upto = cells.withColumn("upto", F.sum("n").over(run.orderBy("cell"))).withColumn("all", F.sum("n").over(run))
    quarter = [F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("cell") / 1000)).alias(f"q{q}") for q in (1, 2, 3)]
    spread = F.sqrt(F.pow(F.greatest(F.col("q3") - F.col("q1"), F.lit(0.001)), 2) + noise**2 / F.greatest(F.col(length), F.lit(1)))
    placed = rows.join(F.broadcast(upto.groupBy("lang").agg(*quarter)), "lang", "left")
    return placed.withColumn(f"z_{score}", (F.col(score) - F.col("q2")) / spread).drop("q1", "q2", "q3")


def fence(good: np.ndarray, bad: np.ndarray, n_good: int, n_bad: int) -> float:
    """The limit above which rejecting pays best: bad texts' share less COST times that of good ones."""
    at = np.unique(np.r_[good, bad])
    lost = len(good) - np.searchsorted(np.sort(good), at, "right")
    won = len(bad) - np.searchsorted(np.sort(bad), at, "right")
    gain = won / n_bad - COST * lost / n_good
    k = int(np.argmax(gain))
    return float((at[k] + at[k + 1]) / 2) if k + 1 < len(at) else float(max(at[k], FENCE))


def ranges(rows: DataFrame, labels: DataFrame | None) -> dict[str, tuple[float, float]]:
    """Permitted z of both scores, word scores first; texts they reject no longer count for the other."""
    out = dict.fromkeys(("z_word_log_perplexity", "z_log_perplexity"), (-FENCE, FENCE))
    if labels is None:
        return out
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    cell = [F.greatest(F.least(F.round(F.coalesce(c, F.lit(0.0)), 1), F.lit(60.0)), F.lit(-60.0)).alias(c) for c in out]
    seen = rows.where(~base_failed() & ~held_out(F.col("doc_id"))).join(known, "doc_id").groupBy("quality", *cell).agg(F.count(F.lit(1)).alias("n")).toPandas()
    y, n = seen["quality"].to_numpy(), seen["n"].to_numpy()
    n_good, n_bad = int(n[y == 1].sum()), int(n[y == 0].sum())
    if not n_good or not n_bad:
        return out
    left = np.ones(len(y), bool)
    for c in out:
        z, limits = seen[c].to_numpy(float), []
        for side in (1, -1):
            v = side * z
            limits.append(fence(*(np.repeat(v[left & (y == k)], n[left & (y == k)]) for k in (1, 0)), n_good, n_bad))
            left &= v <= limits[-1]
        out[c] = (-limits[1], limits[0])
    return out


def judged(docs: DataFrame, model_rows: int = MODEL_ROWS, labels: DataFrame | None = None) -> DataFrame:
    """Every document row with measures, both log perplexities and verdict."""
    rows = scored(docs, model_rows)
    rows = rows.withColumn("key", F.xxhash64("doc_id", "part")).join(word_scores(docs), "key", "left").drop("key")
    rows = rows.withColumn("word_log_perplexity", -F.try_divide("word_total", F.col("n_words").cast("double")))
    rows = rows.withColumn("word_log_perplexity", F.when(~F.isnan("word_log_perplexity"), F.col("word_log_perplexity")))
    rows = written(centred(centred(rows, "word_log_perplexity", "n_words", WORD_NOISE), "log_perplexity", "chars", CHAR_NOISE), "kn-judged")
    within = F.lit(True)
    for c, (low, high) in ranges(rows, labels).items():
        within = within & F.coalesce(F.col(c).between(low, high), F.lit(True))
    return rows.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & within)


@register("op8_ngram_perplexity_rules")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judged(table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "word_log_perplexity"
    )
