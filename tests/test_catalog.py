"""Every query against its SQL, side by side on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from spanloom.plans import catalog

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in SF.glob("*.parquet"):
        c.execute(f"create view {f.stem} as select * from '{f}'")
    return c


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) if not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_its_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, str(SF)).toPandas()
    want = duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_names_what_it_covers():
    assert set(catalog.COVERS) == set(catalog.QUERIES) >= set(catalog.ORACLES)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_queries_without_sql_run(spark, name):
    assert catalog.QUERIES[name](spark, str(SF)).count() > 0


def test_coverage_table_lists_the_queries():
    import re

    text = (Path(__file__).parents[1] / "COVERAGE.md").read_text()
    table = {m[1]: set(re.findall(r"`(\w+)`", m[2])) for m in re.finditer(r"^\| ([A-Z]\d\d) \| (.*?) \|", text, re.M)}
    covered = {}
    for name, ids in catalog.COVERS.items():
        for i in re.findall(r"\b[A-Z]\d\d\b", ids):
            if i in table:
                covered.setdefault(i, set()).add(name)
    assert table == {i: covered.get(i, set()) for i in table} and len(table) == 293
