"""The pipeline on a small corpus with planted cases."""

import random

import corpus_pipeline
from eventfold.llm import packing

RNG = random.Random(11)


def prose(n):
    return " ".join("".join(RNG.choice("abcdefghijklmno") for _ in range(RNG.randrange(3, 9))) for _ in range(n))


def test_stages(spark, tmp_path):
    clean = [(i, "\n".join(prose(20) for _ in range(4))) for i in range(40)]
    shared = prose(30)
    leak = prose(25)
    copy = "\n".join(prose(20) for _ in range(4))
    rows = [
        *clean, (100, "you are an idiot, moron\n" + prose(40)), (101, shared + "\n" + prose(30)), (102, shared[:-1] + "x\n" + prose(30)),
        (103, prose(10) + " " + leak.upper() + " " + prose(10)), (104, " ".join(["tiny words in short lines"] * 9)), (105, " ".join(["Tiny words in short lines"] * 9)),
        (106, None), (107, copy),
    ]
    full = [(i, t, "en", "s", 1, "extra") for i, t in rows]
    spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string, n_chars bigint, part string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i == 100)) for i, _ in rows], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / name))
            docs = spark.read.parquet(str(tmp_path / name))
            kept[name] = {r.doc_id: r.text for r in docs.collect()}
            assert len(kept[name]) == docs.count()
    everything = {i for i, _ in rows}
    assert set(kept["toxicity"]) == everything - {100}
    assert set(kept["line_dedup"]) == everything - {100}
    assert kept["line_dedup"][101] == dict(rows)[101] and "\n" not in kept["line_dedup"][102]
    assert set(kept["near_dedup"]) == everything - {100, 105}
    assert set(kept["decontamination"]) == everything - {100, 105, 103}
    assert all(kept["decontamination"][i] == t for i, t in clean)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} == everything - {100, 105, 103} and {r.capacity for r in got} <= {None, *packing.CAPACITIES}


def test_near_dedup_keeps_different_texts_of_null_and_repeated_ids(spark, docs):
    a, b, c, d = (prose(60) for _ in range(4))
    rows = [(None, a), (None, b), (1, b), (7, c), (7, d), (7, d), (8, d), (None, c.swapcase())]
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup_stage(spark, docs(rows), "").collect()]
    assert sorted(got, key=repr) == sorted([(None, a), (1, b), (7, c), (7, d)], key=repr)


def test_stages_take_maps_and_columns_of_any_name(spark):
    a, b = prose(60), prose(60)
    odd = "doc_id bigint, text string, removed string, _k int, _p int, _q int, _d int, _row int, _part int, tags map<string,int>"
    rows = [(i, t, "r", 1, 2, 3, 4, 5, 6, {"x": i}) for i, t in ((1, a), (2, b + "\n" + a), (7, b), (7, b))] + [(7, b, None, 0, 0, 0, 0, 0, 0, None)]
    docs = spark.createDataFrame(rows, odd)
    lines = corpus_pipeline.line_dedup_stage(spark, docs, "")
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()}[2] == b
    assert {r.removed for r in lines.collect()} == {"r", None}
    left = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 7]


def test_near_dedup_drops_word_edited_copies(spark, docs):
    base = [prose(120).split() for _ in range(6)]
    edited = lambda w, n: " ".join(x + "q" if i in range(5, 5 + 20 * n, 20) else x for i, x in enumerate(w))
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(10 + i, edited(w, 2)) for i, w in enumerate(base)] + [(20 + i, edited(w, 6)) for i, w in enumerate(base)]
    kept = sorted(r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs(rows), "").collect())
    assert kept == [*range(6), *range(20, 26)]  # two edits leave 0.84 of the shingles alike, six 0.59
