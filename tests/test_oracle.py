"""Registered queries against their SQL on the smallest tables."""

import math

import duckdb
import pytest

from tideloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["b1_latest", "c2_stale_drop", "c5_snapshot_grid", "snap_stats", "d2_bars_target", "d3_rolled_bars", "e14_display_bundle", "f6_fills_bid", "f7_asof_lookup", "g2_gonzalo_granger", "g8_fair_quote", "j9_book_top", "l6_har_predict", "n1_registry", "a3_feed_quotes",
          "j3_sliding_bars", "j3_interval_quotes", "j4_sessions", "j7_merge_order", "a10_klines", "a8_pool_polls", "a19_innovations", "m7_smoother",
          "h8_parsing", "h9_pool_math", "h9_pool_quotes", "f10_fees", "f11_groups", "f12_liquidity_factor", "a12_volumes", "n1_aliases", "n2_resolve", "n3_normalize", "n3_denormalize"]


def rows(df):
    cols = sorted(df.columns)
    clean = lambda v: None if v is None or v != v or str(v) in ("<NA>", "NaT") else float(v) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "if" else str(v)
    return cols, sorted((tuple(map(clean, r)) for r in df[cols].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    a, b = rows(con.execute(registry.ORACLE_SQL[name]).df()), rows(registry.QUERIES[name](spark, SF).toPandas())
    assert a[0] == b[0] and len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1]):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and math.isclose(u, v, rel_tol=1e-9, abs_tol=2e-6)), (x, y)


def test_every_query_has_a_name_and_sql_belongs_to_one():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and len(registry.QUERIES) > 120
