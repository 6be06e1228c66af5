"""Every query with SQL gives the rows of that SQL."""

import pytest
from compare import difference

from tallyloom import plans


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_rows_as_sql(spark, sf, name):
    assert difference(plans.QUERIES[name](spark, sf), plans.ORACLE_SQL[name], sf) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLE_SQL)))
def test_runs(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_no_cartesian_product_and_no_python_in_listing(spark, sf, capsys):
    for name in ("search_or_exists", "join_inner", "interval_overlap", "asof_backward_drop", "sum_weighted"):
        plans.QUERIES[name](spark, sf).explain()
        said = capsys.readouterr().out
        assert "CartesianProduct" not in said, name
        assert "Python" not in said and "MapInArrow" not in said, name


def test_filters_and_columns_reach_the_scan(spark, sf, capsys):
    plans.QUERIES["filter_in"](spark, sf).explain()
    said = capsys.readouterr().out
    assert "PushedFilters: [In(event_type" in said and "value" not in said.split("ReadSchema")[1]
