"""Every registered query with SQL gives DuckDB's rows; the rest run."""

import pytest

from strandex.plans.oracle import ORACLES
from strandex.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(against_oracle, name):
    assert against_oracle(SF, QUERIES[name], ORACLES[name]) > 0 or name in ("contains_filter", "multi_any_semi")


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 200
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pushdown(spark):
    """Literal predicates and the columns used reach the Parquet scan."""
    plan = QUERIES["contains_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringContains(text,worthless)" in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan
    plan = QUERIES["prefixed"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url,https://www.)" in plan and "html" not in plan


@pytest.mark.parametrize("name", ["pos_first", "multi_first", "multi_all", "re_find", "count_nonoverlap", "scanf_brand", "lines_split"])
def test_no_shuffle(spark, name):
    assert "Exchange" not in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
