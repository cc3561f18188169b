"""Every query with SQL gives DuckDB's rows: as many, the same texts and whole numbers, real ones within a tolerance."""

import math

import duckdb
import pytest

from cairn.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.01/{t}.parquet'")
    return con


def exact(row):
    """What must be equal, and then the real numbers, as sort key."""
    plain = tuple("" if x is None else str(x) for x in row if not isinstance(x, float))
    return plain, tuple(-math.inf if x is None or isinstance(x, float) and math.isnan(x) else float(x) for x in row if x is None or isinstance(x, float))


def same(x, y, step):
    if x is None or y is None:
        return x is None and y is None
    if isinstance(x, float) or isinstance(y, float):
        if math.isnan(x) or math.isnan(y):
            return math.isnan(x) and math.isnan(y)
        return abs(x - y) <= max(1.01 * step, 1e-9 * abs(x))
    return x == y


def last_digit(values):
    """The step of the rounding that all values have."""
    return next((10.0**-d for d in range(9) if all(round(v, d) == v for v in values)), 1e-9)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    got = catalog.QUERIES[name](spark, "/root/testdata/sf0.01")
    want = duck.execute(catalog.ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    a, b = sorted(map(tuple, got.select(*columns).collect()), key=exact), sorted(want.fetchall(), key=exact)
    assert len(a) == len(b) and a
    for i in range(len(columns)):
        reals = [v for r in b for v in [r[i]] if isinstance(v, float) and math.isfinite(v)]
        step = last_digit(reals) if reals else 0.0
        differ = [(x, y) for x, y in zip(a, b) if not same(x[i], y[i], step)]
        assert not differ, (columns[i], differ[:3])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir.replace("0.001", "0.01")).count() > 0


def test_entry_has_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0
