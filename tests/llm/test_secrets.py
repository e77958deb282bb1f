"""Places against Python's patterns, entropies against counting each window."""

import hashlib
import math
import random
import re
from collections import Counter

from eventfold.llm import secrets
from eventfold.llm.base import table


def model_base(text):
    text, out = text or "", []
    for kind, name, rx, keep in (
        (0, "assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
        (1, "access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        (2, "hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        out += [(m.start(), kind, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(rx, text, re.ASCII) if keep(m)]
    return [x[2] for x in sorted(out)]


def model_entropy(text, width=secrets.WINDOW):
    best = 0.0
    for i in range(len(text) - width + 1):
        best = max(best, -sum(c / width * math.log2(c / width) for c in Counter(text[i : i + width]).values()))
    return best


def check(rows, got):
    want = {i: model_base(t) for i, t in rows}
    assert len(got) == len(rows)
    for r in got:
        base = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == base
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x.startswith(k + ":") for x in base) for k in ("assign", "access", "hex"))


def run(spark, df, tmp_path):
    df.write.parquet(f"{tmp_path}/documents.parquet")
    return secrets.op2(spark, str(tmp_path)).collect()


def test_sf(spark):
    sf = "/root/testdata/sf0.01"
    check([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()], secrets.op2(spark, sf).collect())


def test_odd_texts(spark, docs, tmp_path):
    key = "q8Zr+Kx2/Vn5Tb7Lw9Ys3Hd6"
    rows = [
        (1, None), (2, ""), (3, 'Password = "abc" token=secret:abcdefgh'), (4, "é𝄞 api_key:'x.y=z-1' 𝄞 APIKEY=0"), (5, "AKIA" + "A" * 16 + "xAKIAB"),
        (6, "0" * 24 + "g" + "a" * 23), (7, f"see {key}= now"), (8, "id 123e4567-e89b-12d3-a456-426614174000"), (9, "z" * 24 + "1"),
        (10, "paßword=abcdefg ſecret=abcdefg"), (11, "token=" + "ab1" * 30000), (12, "secret: token=abcdefgh"), (13, "word " * 40000 + key),
        (14, "password=password=password=xy token:\nabcdefg"),
    ]
    got = run(spark, docs(rows), tmp_path)
    check(rows, got)
    spans = {r.doc_id: r.spans for r in got}
    assert spans[7] == f"entropy:4:{4 + len(key) + 1}" and spans[13].startswith("entropy:200000:")
    assert spans[8] == spans[9] == ""


def test_window_entropy(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice("abcdef0123456789"[: rng.randrange(1, 17)]) for _ in range(rng.randrange(20, 90))),) for _ in range(60)]
    got = spark.createDataFrame(rows, "s string").select("s", secrets.window_entropy(secrets.F.col("s")).alias("e")).collect()
    assert all(abs(r.e - model_entropy(r.s)) < 1e-9 for r in got)


def test_no_python_in_plan(spark, docs):
    plan = secrets.scan(docs([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange hash" not in plan
