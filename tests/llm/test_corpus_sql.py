"""The queries of this package that SQL can express, and the registration of all of them."""

import pytest
from compare import difference, sql_result, type_differences

from __spark_entry__ import queries
from opinionloom.llm.queries import QUERIES
from opinionloom.llm.sql import SQL


def test_every_operator_is_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, folder, name):
    result = QUERIES[name](spark, folder)
    expected, types = sql_result(folder, SQL[name])
    assert type_differences(result.dtypes, types) == {}
    assert difference(result.toPandas(), expected) is None


CONTRACT = {
    1: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
    2: "doc_id bigint, n_lines bigint, n_dropped bigint, kept_sha256 string",
    3: "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    4: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    5: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
    7: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
    8: "doc_id bigint, fingerprint string, component_id bigint",
    9: "query_id bigint, rank int, vec_id bigint, score bigint",
    10: "doc_id bigint, held_out boolean, score double, predicted int",
    11: "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    12: "item_id bigint, rank int, doc_id bigint, score bigint",
    13: "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns(spark, folder, name):
    result = QUERIES[name](spark, folder)
    wanted = CONTRACT.get(int(name[2:].split("_")[0]), "doc_id bigint, shard string")
    assert dict(column.split(" ") for column in wanted.split(", ")).items() <= dict(result.dtypes).items()
