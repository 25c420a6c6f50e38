"""Every query of the catalog against its DuckDB SQL, on tables whose blocks have several subtrees."""

import duckdb
import pytest

from txloom.plans import catalog

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_oracle(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    assert got == sorted(map(repr, want.select(*[f'"{c}"' for c in cols]).fetchall()))


def test_queries_without_an_oracle(spark):
    assert set(catalog.QUERIES) - set(catalog.ORACLES) == {"seen_approx_count"}
    exact = {r["txid"]: r["n"] for r in catalog.QUERIES["seen_distinct_count"](spark, SF).collect()}
    for r in catalog.QUERIES["seen_approx_count"](spark, SF).collect():
        assert abs(r["n"] - exact[r["txid"]]) <= max(3, 0.1 * exact[r["txid"]])
