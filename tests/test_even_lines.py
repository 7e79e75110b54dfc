"""Every supplier's lines are spaced, not those of a fifth of the suppliers."""

from spanloom.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_supplier_has_lines(spark):
    got = {r.k for r in catalog.QUERIES["evenly_spaced_lines"](spark, SF).select("k").distinct().collect()}
    all_ = {r[0] for r in spark.read.parquet(f"{SF}/lineitem.parquet").select("l_suppkey").distinct().collect()}
    assert got == all_
