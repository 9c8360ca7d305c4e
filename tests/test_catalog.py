"""Every query of the catalog against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from spindlestat.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(x):
    x = x.item() if hasattr(x, "item") else x
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    got, want = catalog.QUERIES[name](spark, DIR).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = [sorted((tuple(map(plain, r)) for r in x[columns].itertuples(index=False)), key=str) for x in (got, want)]
    assert len(rows[0]) == len(rows[1])
    assert all(same(a, b) for r, s in zip(*rows, strict=True) for a, b in zip(r, s, strict=True))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.QUERIES[name](spark, DIR).count() > 0


def test_gage_queries_read_every_event(spark, con):
    """Against plain sums over all rows: no user, type or later trial is left out."""
    e = con.sql("SELECT user_id, event_type, value FROM events").df()
    cells = e.groupby(["event_type", "user_id"]).value
    ranges = {(r.event_type, r.user_id): r.range for r in catalog.range_by_operator_whole(spark, DIR).collect()}
    assert len(ranges) == len(cells) and all(math.isclose(ranges[key], x.max() - x.min(), abs_tol=1e-5) for key, x in cells)
    anova = catalog.gage_rr_anova_whole(spark, DIR).first()
    assert math.isclose(anova.ss_total, ((e.value - e.value.mean()) ** 2).sum(), rel_tol=1e-6)
    li = con.sql("SELECT l_quantity AS q FROM lineitem").df().q
    assert math.isclose(catalog.gage_rr_anova(spark, DIR).first().ss_total, ((li - li.mean()) ** 2).sum(), rel_tol=1e-6)
    assert math.isclose(catalog.gage_rr_range_whole(spark, DIR).first().pv, (m := e.groupby("user_id").value.mean()).max() / 2.326 - m.min() / 2.326, rel_tol=1e-6)
