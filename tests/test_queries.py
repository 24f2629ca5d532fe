"""Every registered query of the phonotactic operators against its SQL."""

import pytest

from sonority.jobs import catalogue


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].values.tolist())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_matches_its_sql(spark, duck, sf_dir, name):
    assert rows(catalogue.QUERIES[name](spark, sf_dir).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["c1", "c2", "weight", "violations"]
