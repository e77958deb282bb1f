"""Small tables for the text operators' tests."""

import pytest

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp string, key string"


@pytest.fixture
def docs(spark):
    """Builds a documents table from (doc_id, text) pairs, with extra columns of clashing names."""

    def make(rows, partitions=3):
        full = [(i, t, "en", "src0", None if t is None else len(t), "x", "y") for i, t in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)

    return make
