import pytest

import __spark_entry__
from echograin.plans import catalogue, catalogue_files  # noqa: F401


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_query_agrees_with_sql(name, same):
    same(catalogue.QUERIES[name], catalogue.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE)))
def test_query_without_sql_gives_rows(name, spark, sf):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert {"row", "col", "min_z", "n"} == set(__spark_entry__.entry(spark).columns)
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    catalogue.class_filter_box(spark, sf).select("z").explain("formatted")
    plan = capsys.readouterr().out
    catalogue.U(spark, sf).where("pulse_id < 100").select("zenith").explain("formatted")
    plan = capsys.readouterr().out
    assert "PushedFilters: [IsNotNull(o_orderkey), LessThan(o_orderkey,100)]" in plan
    assert "ReadSchema: struct<o_orderkey:bigint>" in plan


def test_unused_return_number_costs_no_shuffle(spark, sf, capsys):
    catalogue.P(spark, sf).select("x", "y").explain("formatted")
    assert "Window" not in capsys.readouterr().out
