"""Every query of the loan engine: against its SQL where it has one, else that it has rows."""

import importlib.util

import pytest

import __spark_entry__ as entry
from tests.oracle import by_spark, by_sql

#: test_cases.py runs these with fewer trees; fit_gbt is run here with all of them.
FEWER_TREES = {"tree_contributions", "importance_join", "gain_importance", "compact_model"}
OWN, SQL = entry._own().QUERIES, entry._own().ORACLE_SQL


@pytest.mark.parametrize("name", [n for n in OWN if n in SQL])
def test_query_equals_sql(spark, sf, name):
    assert by_spark(OWN[name](spark, sf)) == by_sql(sf, SQL[name])


@pytest.mark.parametrize("name", [n for n in OWN if n not in SQL and n not in FEWER_TREES])
def test_query_has_rows(spark, sf, name):
    assert not OWN[name](spark, sf).isEmpty()


def test_entry(spark):
    assert entry.entry(spark).count() == 4


def test_llm_queries_are_there_only_with_their_folder():
    there = importlib.util.find_spec("ledgerspark.llm") is not None and importlib.util.find_spec("ledgerspark.llm.queries") is not None
    assert any(n.startswith("op1_") for n in entry.queries()) == there


def test_names_need_no_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parent.parent, capture_output=True).returncode == 0
