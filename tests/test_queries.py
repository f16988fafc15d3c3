"""Every core query against its SQL on the smallest tables."""

from __future__ import annotations

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from twinscript.queries import core

DATA = "/root/testdata/sf0.001"
QUERIES, ORACLES = core()


def norm(v) -> str:
    if isinstance(v, (list, np.ndarray)):
        return "[" + ",".join(map(norm, v)) + "]"
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)):
        return f"{float(v):.10g}"
    if isinstance(v, pd.Timestamp):
        return str(v.tz_localize(None) if v.tzinfo else v)
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(norm(v) for v in r) for r in df[sorted(df.columns)].values.tolist())


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    c = duckdb.connect()
    c.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLES:
        want = duck.execute(ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_work_rows_tell_null_from_empty(spark, tmp_path):
    works = [("0001A.B", 1, "", "T", None, None, 1), ("0002A.B", 2, None, "", 3, "", 1), ("A.B", 3, "N", None, 4, "law", 1), ("C.D", 4, "", "", 5, "law", 0), ("E.F", 5, "N", "T", None, None, None), (None, 6, "N", "T", 7, "law", 1)]
    spark.createDataFrame(works, "uri string, priority_rank int, author string, title string, author_death_ah int, genre string, meta_found int").write.parquet(str(tmp_path / "works.parquet"))
    c = duckdb.connect()
    c.execute(f"create view works as select * from '{tmp_path}/works.parquet/*.parquet'")
    got = [tuple(r) for r in QUERIES["work_rows"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(c.execute(ORACLES["work_rows"]).fetchall())
