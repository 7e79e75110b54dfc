"""Extents are those of the table, whatever its size."""

from spanloom.plans import catalog


def test_slabs_reach_the_last_order(spark, tmp_path):
    keys = [0, 14_999, 15_000, 39_999, 41_234]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    spark.createDataFrame([(0,)], "r_regionkey int").write.parquet(str(tmp_path / "region.parquet"))
    got = {r.lo: (r.hi, r.n) for r in catalog.QUERIES["slab_jobs"](spark, str(tmp_path)).collect()}
    want = {lo: min(lo + 1000, 41_235) for lo in range(0, 41_235, 700)}
    assert got == {lo: (hi, sum(lo <= k < hi for k in keys)) for lo, hi in want.items()}


def test_pooling_reaches_the_last_supplier(spark, tmp_path):
    rows = [(k, 3 * k, 1, float(k)) for k in (0, 97, 98, 500, 993, 994, 999)]
    spark.createDataFrame(rows, "l_suppkey bigint, l_partkey bigint, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.i, r.j, r.v) for r in catalog.QUERIES["pool_max_cropped"](spark, str(tmp_path)).collect()}
    # 1,000 across make 142 blocks of 7; what is over, from 994 on, is cut off, and so is j of 56 and more.
    assert got == {(k // 7, p % 60 // 7, v) for k, p, _, v in rows if k < 994 and p % 60 < 56}
