"""The registered queries over the given tables: SQL where there is some, else columns and row counts."""

import os

import pytest
from compare import SF, assert_same, connected

from codequarry.llm import queries

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")
COLUMNS = {
    "op1_license_scan": ["doc_id", "license", "containment"], "op2_simhash_dedup": ["doc_id", "fingerprint", "component_id"], "op3_sentencepiece": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op4_language_id": ["doc_id", "lang", "kept"], "op5_sharding": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"], "op6_toxicity": ["doc_id", "held_out", "score", "predicted"],
    "op7_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"], "op8_topk_search": ["query_id", "rank", "vec_id", "score"],
    "op9_line_dedup": ["doc_id", "n_lines", "n_dropped", "kept_sha256"], "op10_url_filter": ["page_id", "host", "path", "rule", "verdict"],
}
TYPES = {"doc_id": "bigint", "n_tokens": "bigint", "size": "bigint", "text_crc32": "bigint", "shard": "int", "slot": "bigint", "grown_shard": "int", "held_out": "boolean", "score": ("double", "bigint"), "predicted": "int", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "contaminated": "boolean", "query_id": "bigint", "rank": "int", "vec_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "page_id": "bigint"}


def test_one_query_an_operator():
    assert sorted(queries.QUERIES) == sorted(COLUMNS) and set(queries.oracles()) <= set(COLUMNS)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, name):
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert set(COLUMNS[name]) <= set(types)
    for c in COLUMNS[name]:
        want = TYPES.get(c, "string" if c not in ("containment", "component_id", "kept") else types[c])
        assert types[c] in (want if isinstance(want, tuple) else (want,)), c
    if name in queries.oracles():
        assert_same(connected(), df, queries.oracles()[name])
    elif name != "op1_license_scan":
        assert df.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
