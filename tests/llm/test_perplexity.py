"""Measures and the Kneser-Ney model against sequential versions."""

import math
import re
from collections import Counter, defaultdict

import pytest

from eventfold.llm import perplexity
from eventfold.llm.base import table


def model_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(tri)
    hit = {i + k for i, t in enumerate(tri) if often[t] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def model_scores(docs):
    """Log perplexity per row, one language at a time, by dictionaries."""
    out = {}
    for lang in {x for _, x, _ in docs}:
        top = perplexity.ORDER
        own = [(i, "\0" * (top - 1) + t) for i, x, t in docs if x == lang and t]
        counts = {top: Counter(t[k - top + 1 : k + 1] for _, t in own for k in range(top - 1, len(t)))}
        for n in range(top - 1, 0, -1):
            counts[n] = Counter(g[1:] for g in counts[n + 1])
        d, total, spread = {}, defaultdict(int), defaultdict(float)
        for n, c in counts.items():
            t = [sum(v == i for v in c.values()) for i in range(5)]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + t[2] else None
            d[n] = [0] + [max(0.05, min(i - (i + 1) * y * t[i + 1] / t[i] if y is not None and t[i] else 0.5 * i, i - 0.05)) for i in (1, 2, 3)]
            for g, v in c.items():
                total[n, g[:-1]] += v
                spread[n, g[:-1]] += d[n][min(v, 3)]

        def p(g):
            n = len(g)
            low = p(g[1:]) if n > 1 else 1 / (len(counts[1]) + 1)
            return (counts[n][g] - d[n][min(counts[n][g], 3)] + spread[n, g[:-1]] * low) / total[n, g[:-1]]

        for i, t in own:
            out[i] = -sum(math.log(p(t[k - top + 1 : k + 1])) for k in range(top - 1, len(t))) / (len(t) - top + 1)
    return out


@pytest.fixture
def some(spark):
    rows = [(r.doc_id, r.lang, r.text) for r in table(spark, "/root/testdata/sf0.001", "documents").collect()][:60]
    rows += [(900, None, "no language here"), (901, "en", None), (902, "fr", ""), (903, "xx", "é　x\u0085 \x0b#$"), (904, "en", "a b c a b c\n\nx\nx\n x\n" * 30)]
    df = spark.createDataFrame([(*r, "p", 1) for r in rows], "doc_id bigint, lang string, text string, part string, total int").repartition(4)
    return rows, df


@pytest.mark.parametrize("model_rows", [10**9, 0])
def test_against_model(some, model_rows):
    rows, df = some
    got = {r.doc_id: r for r in perplexity.judged(df, model_rows).collect()}
    want = model_scores([(i, x, t) for i, x, t in rows])
    assert len(got) == len(rows)
    for i, _, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == model_measures(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert (r.log_perplexity is None) == (i not in want)
        if i in want:
            assert abs(r.log_perplexity - want[i]) < 1e-4
        assert not (r.kept and r.base_failed)


def test_empty_and_repeated(spark, some):
    _, df = some
    assert perplexity.judged(df.where("false")).collect() == []
    twice = perplexity.judged(df.where("doc_id < 5").union(df.where("doc_id < 5"))).collect()
    assert len(twice) == 10 and len({(r.doc_id, r.log_perplexity) for r in twice}) == 5


def test_rejects_noise_keeps_prose(spark):
    rows = {r.doc_id: r for r in perplexity.op8(spark, "/root/testdata/sf0.01").collect()}
    quality = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    good = [rows[i] for i, q in quality.items() if q == 1 and not rows[i].base_failed]
    assert sum(r.kept for r in good) / len(good) > 0.985


@pytest.mark.parametrize("head", [10**6, 3])
def test_word_scores_leave_the_own_fold_out(some, head):
    rows, df = some
    scores = perplexity.word_scores(df, head)
    got = {r.doc_id: r.word_total for r in df.withColumn("key", perplexity.document_key()).join(scores, "key").collect()}
    for i, lang, text in rows:
        own = (text or "").encode()
        other = Counter(w for _, x, t in rows if x == lang and t and perplexity._fold(t.encode()) != perplexity._fold(own) for w in t.encode().split())
        if own.split() and other:
            want = sum(math.log((max(other[w] - 0.75, 0) + 0.75 * len(other) / (len(other) + 1)) / sum(other.values())) for w in own.split())
            assert abs(got[i] - want) < 1e-6 * abs(want)


def test_rejects_texts_labelled_bad(spark):
    rows = {r.doc_id: r for r in perplexity.op8(spark, "/root/testdata/sf0.01").collect()}
    quality = {r.doc_id: r.quality for r in table(spark, "/root/testdata/sf0.01", "labels").collect()}
    bad = [rows[i] for i, q in quality.items() if q == 0 and not rows[i].base_failed]
    assert sum(not r.kept for r in bad) / len(bad) > 0.5
