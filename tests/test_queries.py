"""Registered queries against their SQL at the smallest scale, where the driver tables are at hand."""

import os
import sys

import duckdb
import pytest

from evigrid.plans import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("t1_job_page", "a7_check_rollup", "j1_channel_conflicts", "w14_stage_durations", "x1_package_hints", "x3_dimensions", "t9_hybrid_search", "j5_nearest_lines",
          "a9_fused_parameters", "v3_derived_parameters", "v6_package_geometry", "x12_verify_records", "j17_merged_pins")
NAMES = sorted(ORACLES) if os.environ.get("EVIGRID_ALL_QUERIES") else SAMPLE


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are absent")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
    from check_queries import TABLES, norm
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted(tuple(norm(v) for v in r) for r in df.select(*columns).collect())
    cur = con.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    want = sorted(tuple(norm(r[names.index(c)]) for c in columns) for r in cur.fetchall())
    assert got == want and got
