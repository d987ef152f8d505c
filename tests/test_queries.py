"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from agestrata.plans import all_oracles, all_queries
from tools.check_oracle import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    verdict, _, _, notes = compare(spark, con, name, SF)
    assert verdict in ("same", "rows only"), notes


def test_only_eigenvectors_lack_sql():
    assert set(all_queries()) - set(all_oracles()) == {
        "principal_components",
        "coherent_forecast",
        "rolling_coherent_backtest",
    }


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["Policy", "policy_rank", "Year", "Lo", "Hi", "OADR"]
    assert df.count() > 0


def test_views_grow_with_the_tables(spark):
    from agestrata.plans import views

    small, large = (
        views.sim(spark, f"/root/testdata/{sf}").count() for sf in ("sf0.001", "sf0.01")
    )
    assert large > 5 * small
