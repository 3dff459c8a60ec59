"""Every delivery query against its DuckDB twin, and the contract of the entry module."""

import importlib

import pytest

from lanewise.oracles import ORACLES
from lanewise.queries import QUERIES


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, same_rows, name):
    same_rows(QUERIES[name](spark, sf_dir), ORACLES[name])


@pytest.mark.parametrize("name", ["kpi_delivery_daily", "sql_kpi_delivery_daily", "sql_agg_shipment_daily", "reconciliation_join", "union_all_checks", "agg_event_left_join"])
def test_query_can_be_written(spark, sf_dir, name):
    """A write plans anew: a frame that goes into a plan twice must allow that."""
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()


def test_entry(spark, sf_dir):
    entry = importlib.import_module("__spark_entry__")
    assert entry.entry(spark).count() > 0
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filter_and_columns_reach_the_scan(spark, sf_dir, capsys):
    QUERIES["scan_lineitem_pruned"](spark, sf_dir).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(l_quantity,45.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_quantity:double,l_linestatus:string>" in plan


def test_latest_row_drops_losers_before_the_shuffle(spark, sf_dir, capsys):
    QUERIES["latest_shipment"](spark, sf_dir).explain()
    assert "WindowGroupLimit" in capsys.readouterr().out


@pytest.mark.parametrize("missing", ["xxhash", "lanewise.llm", "corpus_pipeline"])
def test_entry_without_what_the_training_data_queries_need(missing):
    import os
    import subprocess
    import sys
    from pathlib import Path

    code = f"import sys; sys.modules[{missing!r}] = None\nimport __spark_entry__ as e\nprint(*e.queries())\nassert set(e.oracle_sql()) <= set(e.queries())"
    root = str(Path(__file__).resolve().parents[1])
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=root, env=os.environ | {"PYTHONPATH": root}, check=True).stdout.split()
    assert set(QUERIES) <= set(out) and "pipeline" not in out
