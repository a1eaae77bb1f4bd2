import os

import duckdb
import pytest

import __spark_entry__ as entry
from tools.oracle_check import digest

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "user_dashboard", "access_states", "document_list", "keyset_page", "hourly_request_limits", "sliding_message_limit", "duplicate_messages", "pins",
    "document_passages", "vector_search", "question_facts", "rule_answers", "answer_audit", "integrity_issues", "rule_confirmations", "upload_admission", "items_for_profiles",
]
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables absent")


def test_registry_is_consistent(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(SAMPLE) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["doc_id", "passages", "characters", "tokens", "any_reordered"]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(list(rel.columns), rel.fetchall())[0]
