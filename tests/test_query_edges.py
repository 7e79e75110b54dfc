"""Queries at the edges of their values: equal to their SQL on small tables made for it."""

import math

import duckdb
import pytest

from spanloom.plans import catalog


def _same(spark, folder, name, **tables):
    """Rows of the query, which must be those of its SQL; ``tables``: (rows, schema)."""
    con = duckdb.connect()
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{table}.parquet")
        con.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in catalog.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    assert sorted(got) == sorted(want.fetchall())
    return got


def test_phases_round_as_sums_do(spark, tmp_path):
    # 6.25 added to a phase rounds it: 0.02 and 6.27 % 6.25 then are equal or not as sums are, not as remainders.
    rows = [(k, 1, round(-9.99 + 0.01 * ((k * 7919) % 5000), 2)) for k in range(5000)]
    assert len(_same(spark, tmp_path, "phase_order", customer=(rows, "c_custkey bigint, c_nationkey int, c_acctbal double"))) == len(rows)


@pytest.mark.parametrize("line", [7, 1])
def test_volumes_all_on_one_side_have_no_distances(spark, tmp_path, line):
    from datetime import datetime

    rows = [(datetime(1996, m, 1), float(q), x / 100, line) for m in (1, 2, 3) for q in (1, 2) for x in (0, 1)]
    schema = "l_shipdate timestamp, l_quantity double, l_discount double, l_linenumber int"
    assert _same(spark, tmp_path, "volume_distances", lineitem=(rows, schema)) == []


def test_samples_at_the_centre_keep_their_side(spark, tmp_path):
    # A value of 0 lies at (0, 0), its x of -0.0 where the cosine is negative: the angle is half a turn.
    rows = [(e, "signup", 0.0, 3 + e) for e in range(20, 60)]
    assert any(math.cos(0.7 * e) < 0 for e, *_ in rows)
    schema = "event_id bigint, event_type string, value double, user_id bigint"
    _same(spark, tmp_path, "loss_map_entries", events=(rows, schema))
