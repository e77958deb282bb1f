"""The registered queries against their SQL, and their columns, on the smallest tables."""

import pytest

import oracle
from eventfold.llm import registry

SF = "/root/testdata/sf0.001"
COLUMNS = {
    2: "doc_id n_assign n_access n_hex base_sha256 spans", 3: "doc_id held_out score predicted", 4: "doc_id fingerprint component_id",
    5: "page_id payload_bytes payload_digest record_type refers_to", 7: "doc_id n_words n_hit n_items items_sha256 contaminated",
    8: "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept", 9: "doc_id held_out lang_pred score",
    11: "doc_id n_a n_b n_groups n_links n_best count_sum groups_sha256", 12: "vec_id component n deviation whitened explained identity_error",
    13: "doc_id n_email n_ip n_card n_phone base_sha256 spans",
}
#: Table and id of the queries that are not over documents.
TABLES = {12: ("embeddings", "vec_id")}


def number(name):
    return int(name[2:].split("_")[0])


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert oracle.compare(spark, oracle.connect(SF), registry.RUNS[name], registry.SQL[name], SF) is None


def test_one_query_per_operator():
    assert sorted(map(number, registry.RUNS)) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(set(registry.RUNS) - set(registry.SQL)))
def test_every_row_of_the_table_is_in_the_result(spark, name):
    got = registry.RUNS[name](spark, SF)
    want = COLUMNS.get(number(name), "doc_id").split()
    assert got.columns[: len(want)] == want
    table, key = TABLES.get(number(name), ("documents", "doc_id"))
    ids = sorted(r[0] for r in got.select(key).distinct().collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect())
