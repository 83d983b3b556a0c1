from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from folioflow.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("tests", master="local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))})
    session.sparkContext.setLogLevel("ERROR")
    session.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture(scope="session")
def same_rows():
    """Order-insensitive comparison of two pandas frames by column name and value."""
    import math
    from collections import Counter

    import pandas as pd

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA:
            return None
        if isinstance(x, pd.Timestamp):
            return (x.tz_convert("UTC").tz_localize(None) if x.tzinfo else x).isoformat()
        x = x.item() if hasattr(x, "item") else x
        if isinstance(x, float):
            return None if math.isnan(x) else int(x) if x == int(x) else round(x, 6)
        return x

    def check(a, b):
        assert sorted(a.columns) == sorted(b.columns)
        order = sorted(a.columns)
        x, y = (Counter(tuple(map(plain, r)) for r in f[order].itertuples(index=False, name=None)) for f in (a, b))
        assert x == y, (list((x - y).items())[:3], list((y - x).items())[:3])

    return check
