"""Every query with SQL gives the rows that DuckDB gives, at the smallest scale."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from quern.plans import catalogue, review  # noqa: F401

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_equal_rows(spark, name):
    found = catalogue.QUERIES[name](spark, SF)
    rows = sorted(repr(tuple(plain(r[c]) for c in sorted(found.columns))) for r in found.collect())
    if name not in catalogue.ORACLES:
        assert rows
        return
    with duckdb.connect() as db:
        for p in Path(SF).glob("*.parquet"):
            db.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        expected = db.sql(catalogue.ORACLES[name])
        columns = expected.columns
        at = [columns.index(c) for c in sorted(found.columns)]
        assert sorted(columns) == sorted(found.columns)
        assert rows == sorted(repr(tuple(plain(r[i]) for i in at)) for r in expected.fetchall())
