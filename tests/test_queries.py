"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from seclake.queries.base import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
SAMPLE = [
    "redact_notes", "markdown_sections", "chunk_ids", "dedupe_normalized", "html_to_text", "hybrid_search", "pack_context",
    "eval_cases", "confidence_scores", "evidence_union", "traffic_rule_counts", "posture_crypto", "replace_documents",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DIR}/{name}.parquet'")
    yield con
    con.close()


def test_every_check_has_its_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert set(QUERIES) <= set(contract.queries())
    assert len(QUERIES) - len(ORACLES) == 2


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_sql(spark, duck, name):
    frame = contract.queries()[name](spark, DIR)
    columns = sorted(frame.columns)
    result = duck.execute(contract.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns

    def keyed(rows):
        return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))

    expected = keyed([tuple(r[names.index(c)] for c in columns) for r in result.fetchall()])
    assert keyed([tuple(r[c] for c in columns) for r in frame.collect()]) == expected and expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
