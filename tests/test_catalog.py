"""Every query with a DuckDB twin gives the twin's rows."""

from decimal import Decimal

import duckdb
import pytest

from docweave.plans import catalog

TABLES = "documents embeddings pages labels benchmark region nation customer supplier part orders lineitem events conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    assert not isinstance(v, Decimal), "a DuckDB twin must not give decimals"
    return None if v is None or v != v else round(v, 9) if isinstance(v, float) else v


def rows(cols, found):
    order = sorted(range(len(cols)), key=lambda k: cols[k])
    return sorted(repr([plain(r[k]) for k in order]) for r in found)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, sf_dir, name):
    df = catalog.queries()[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    if name in catalog.oracle_sql():
        want = duck.sql(catalog.oracle_sql()[name])
        assert sorted(df.columns) == sorted(want.columns)
        assert got == rows(want.columns, want.fetchall())
    else:
        assert got


def test_migration_is_one_projection(spark, sf_dir):
    """No shuffle, no Python, and only the mapped columns are read."""
    df = catalog.queries()["xf_code_to_enum"](spark, sf_dir)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "o_totalprice" not in plan


def test_topk_limits_before_the_shuffle(spark, sf_dir):
    plan = catalog.queries()["tok_overlap_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
