"""Toxicity as a weighted finite-state grammar over clauses.

A clause is a run of words between sentence marks, semicolons, colons, bars or line ends.
Its words become symbols, and small transducers read them together: *insult* and *threat*
give weight, *target* raises the weight of what stands near an addressed person,
*negation* and *reported speech* lower it. Their composition is one table of states; a
clause's score is the weight along its path. A document's score is a logistic function of
its clauses, fitted on labelled rows.

The insult words are partly fixed and partly learned: of the words and word beginnings of a
bounded sample of labelled texts, those are taken that mark toxic texts beyond chance, one
at a time, each for the toxic texts that those before it leave unexplained.

The sample takes at most SAMPLE_TOXIC and SAMPLE_CLEAN different texts, by smallest text
hash. Counting is done by Spark; the driver gets the features that pass the test.

Defined cases: null and empty texts have no clause and get the score of texts without any
match. Rows without a label, or with a null one, are not learned from. Without both
classes among the learnable rows, only the fixed words count. Repeated rows get equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventfold.llm.base import held_out, register, table, written

SAMPLE_TOXIC, SAMPLE_CLEAN = 3000, 6000
THRESHOLD = 0.3
PREFIXES = range(3, 7)
#: Features expected to pass the test by luck, among words and among beginnings.
LUCK = 0.3

INSULTS = "idiot moron stupid pathetic worthless disgusting loser clown trash scum".split()
THREATS = "kill murder hurt destroy strangle shoot stab töten umbringen tuer matar".split()
TARGETS = "you your yours du dich dein ihr tu toi vous te tú ti usted".split()
NEGATIONS = "not never nicht kein keine pas jamais nunca jamás".split()
REPORTS = "said says wrote claimed quoted sagte schrieb behauptete dit écrit dijo escribió".split()

OTHER, TARGET, NEGATION, REPORT, THREAT, INSULT = range(6)
SYMBOLS = 6
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;:|\n]")
_MARK = frozenset(".!?;:|\n")


class Transducer:
    """Reads symbols; each step gives the next state and a factor for the symbol's weight."""

    def __init__(self, states: int, step):
        self.states = states
        self.next = np.zeros((states, SYMBOLS), np.int64)
        self.factor = np.ones((states, SYMBOLS))
        for s, x in product(range(states), range(SYMBOLS)):
            self.next[s, x], self.factor[s, x] = step(s, x)

    def compose(self, other: Transducer) -> Transducer:
        """Both read the same symbols; factors multiply."""

        def step(s, x):
            a, b = divmod(s, other.states)
            return self.next[a, x] * other.states + other.next[b, x], self.factor[a, x] * other.factor[b, x]

        return Transducer(self.states * other.states, step)


def _near(symbol: int, reach: int, factor: float) -> Transducer:
    """Weights change for ``reach`` words after the symbol."""
    return Transducer(reach + 1, lambda s, x: (reach if x == symbol else max(s - 1, 0), factor if s and x >= THREAT else 1.0))


def _after(symbol: int, factor: float) -> Transducer:
    """Weights change in the rest of the clause after the symbol."""
    return Transducer(2, lambda s, x: (1 if s or x == symbol else 0, factor if s and x >= THREAT else 1.0))


#: A threat counts fully only with a target before it; an insult counts by itself.
_THREAT = Transducer(2, lambda s, x: (1 if s or x == TARGET else 0, 0.3 if x == THREAT and not s else 1.0))
GRAMMAR = _near(TARGET, 4, 1.5).compose(_near(NEGATION, 2, 0.5)).compose(_after(REPORT, 0.7)).compose(_THREAT)
_NEXT, _FACTOR = GRAMMAR.next.tolist(), GRAMMAR.factor.tolist()


class Lexicon(dict):
    """Word to (symbol, weight); unseen words are looked up by their beginnings and kept."""

    ROOM = 400_000

    def __init__(self, learned: dict[str, float]):
        fixed = {}
        for symbol, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)):
            fixed |= {w: (symbol, 1.0) for w in words}
        fixed |= {f[1:]: (INSULT, w) for f, w in learned.items() if f[0] == "="}
        fixed |= dict.fromkeys(_MARK)
        self.fixed = fixed
        self.starts = {f[1:]: (INSULT, w) for f, w in learned.items() if f[0] == "^"}
        super().__init__(fixed)

    def __missing__(self, word: str):
        if len(self) > self.ROOM:
            self.clear()
            self.update(self.fixed)
        found = next((self.starts[word[:n]] for n in PREFIXES if len(word) > n and word[:n] in self.starts), (OTHER, 0.0))
        self[word] = found
        return found


def clauses(text: str, lexicon: Lexicon) -> list[tuple[int, int, float]]:
    """Clauses with weight: (first character, end, score)."""
    low = text.lower()
    tokens = _TOKEN.findall(low)
    read = [lexicon[t] for t in tokens]
    if not any(x and x[0] >= THREAT for x in read):
        return []
    if len(low) != len(text):  # lower case of a few letters is longer
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    out, state, score, first, last = [], 0, 0.0, 0, 0
    for m in _TOKEN.finditer(low):
        x = lexicon[m[0]]
        if x is None:
            if score:
                out.append((first, last, score))
            state, score, first = 0, 0.0, m.end()
            continue
        score += x[1] * _FACTOR[state][x[0]] if x[0] >= THREAT else 0.0
        state, last = _NEXT[state][x[0]], m.end()
    if score:
        out.append((first, last, score))
    return out


def signals(found: list[tuple[int, int, float]]) -> tuple[float, float, float]:
    """Inputs of the document score: any match, best clause, all clauses."""
    scores = [s for _, _, s in found]
    return (1.0 if scores else 0.0), max(scores, default=0.0), math.log1p(sum(scores))


def _features(text: str) -> set[str]:
    out = set()
    for w in set(re.findall(r"[^\W\d_]+", text.lower())):
        out.add("=" + w)
        out.update("^" + w[:n] for n in PREFIXES if len(w) > n)
    return out


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled texts to learn from: rows (text, toxic), different texts only."""
    hashed = docs.select("doc_id", F.xxhash64("text").alias("h")).where(~held_out(F.col("doc_id")))
    marked = hashed.join(labels.select("doc_id", "toxic").where("toxic is not null"), "doc_id")
    each = marked.groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id"))
    picked = each.where("toxic = 1").orderBy("h").limit(SAMPLE_TOXIC).union(each.where("toxic = 0").orderBy("h").limit(SAMPLE_CLEAN))
    ids = F.broadcast(picked.select("doc_id", "h", "toxic"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h")).join(ids, ["doc_id", "h"])
    return written(rows.dropDuplicates(["h"]).select("text", "toxic").repartition(24), "toxicity-sample")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())
    for batch in batches:
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            counts[toxic].update(_features(text))
    names = list(counts[1])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([0] * len(names), pa.int64())], names=["f", "pos", "neg"])
    names = list(counts[0])
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([0] * len(names), pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["f", "pos", "neg"])


def _surprise(pos, neg, base: float):
    """Bound on minus the log chance of so many toxic texts among those with a feature."""
    n = np.maximum(pos + neg, 1e-9)
    p = np.clip(pos / n, 1e-12, 1 - 1e-12)
    return np.where(p > base, n * (p * np.log(p / base) + (1 - p) * np.log((1 - p) / (1 - base))), 0.0)


def learn_words(rows: DataFrame) -> dict[str, float]:
    """Features that mark toxic texts, with weights."""
    sizes = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if not sizes.get(1) or not sizes.get(0):
        return {}
    base = sizes[1] / (sizes[0] + sizes[1])
    counted = written(
        rows.mapInArrow(_count, "f string, pos bigint, neg bigint").groupBy("f").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos >= 3"),
        "toxicity-features",
    )
    tried = {r.k: r["count"] for r in counted.groupBy(F.substring("f", 1, 1).alias("k")).count().collect()}
    limits = {k: math.log(n / LUCK) for k, n in tried.items()}
    # no feature with fewer toxic texts can pass
    enough = {k: limit / -math.log(base) for k, limit in limits.items()}
    likely = counted.where(
        "pos >= case when f like '^%' then {} else {} end".format(enough.get("^", 0), enough.get("=", 0))
    ).where(F.col("pos") > 2 * base * (F.col("pos") + F.col("neg"))).toPandas()
    likely = likely[_surprise(likely.pos.to_numpy(), likely.neg.to_numpy(), base) >= likely.f.str[:1].map(limits).to_numpy(float)]
    chosen = {f: i for i, f in enumerate(sorted(likely.f))}

    def incidence(batches):
        for batch in batches:
            hit = [[chosen[f] for f in _features(t) if f in chosen] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hit, pa.list_(pa.int32())), batch.column(1)], names=["hit", "toxic"])

    got = rows.mapInArrow(incidence, "hit array<int>, toxic int").where("size(hit) > 0").collect()
    toxic = np.array([r.toxic for r in got], np.int64)
    at, feature = np.array([(i, f) for i, r in enumerate(got) for f in r.hit], np.int64).reshape(-1, 2).T
    names, open_, out = list(chosen), np.ones(len(got), bool), {}
    limit = np.array([limits[f[0]] for f in names])
    while len(names):
        use = open_[at] | (toxic[at] == 0)
        pos, neg = (np.bincount(feature[use & (toxic[at] == t)], minlength=len(names)) for t in (1, 0))
        gain = _surprise(pos, neg, base) - limit
        best = int(gain.argmax())
        if gain[best] < 0:
            break
        out[names[best]] = float(np.clip(math.log((pos[best] + 0.5) / (neg[best] + 0.5)) / 4, 0.25, 2.0))
        open_[at[feature == best]] = False
    return out


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, intercept first, by Newton steps."""
    x = np.c_[np.ones(len(x)), x]
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + (ridge + 1e-9) * np.eye(len(b))
        move = np.linalg.solve(h, g)
        b += np.clip(move, -4, 4)
        if np.abs(move).max() < 1e-6:
            break
    return b


class Model:
    def __init__(self, words: dict[str, float], coefficients: list[float]):
        self.words, self.coefficients = words, coefficients

    def score(self, found) -> float:
        z = self.coefficients[0] + sum(c * x for c, x in zip(self.coefficients[1:], signals(found), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn words and the document score from labelled rows outside the held-out fold."""
    rows = sample(docs, labels)
    words = learn_words(rows)

    def read(batches):
        lexicon = Lexicon(words)
        for batch in batches:
            xs = [signals(clauses(t, lexicon)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.float64()) for c in (list(zip(*xs)) or [[], [], []])), batch.column(1)], names=["a", "b", "c", "toxic"])

    got = np.array(rows.mapInArrow(read, "a double, b double, c double, toxic int").collect(), float).reshape(-1, 4)
    if len(set(got[:, 3])) < 2:
        return Model(words, [-4.0, 4.0, 1.0, 0.0])
    known = labels.where("toxic is not null and not " + "(pmod(crc32(cast(cast(doc_id as string) as binary)), 4) <=> 2)").groupBy("toxic").count().collect()
    true = {r.toxic: r["count"] for r in known}
    each = {t: true.get(t, 1) / sum(true.values()) / max((got[:, 3] == t).sum(), 1) * len(got) for t in (0, 1)}
    weight = np.where(got[:, 3] == 1, each[1], each[0])
    return Model(words, logistic(got[:, :3], got[:, 3], weight).tolist())


def scorer(model: Model):
    """The score alone, as a column function of the text, for filtering whole rows."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon(model.words)
        for part in parts:
            yield pd.Series([model.score(clauses(t, lexicon) if t else []) for t in part], dtype=float)

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score, clauses) for every document row."""
    kind = dict(docs.dtypes)["doc_id"]
    clause = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        lexicon = Lexicon(model.words)
        for batch in batches:
            found = [clauses(t, lexicon) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([model.score(f) for f in found], pa.float64()),
                    pa.array([[{"start": a, "end": b, "score": s} for a, b, s in f] for f in found], clause),
                ],
                names=["doc_id", "score", "clauses"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, clauses array<struct<start:bigint,end:bigint,score:double>>")


@register("op3_toxicity_grammar")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from the labelled rows outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.size("clauses").alias("n_clauses"),
    )
