import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-tests-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    c = duckdb.connect()
    for path in sorted(Path(sf).glob("*.parquet")):
        c.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return c


def plain(value):
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if value is None or isinstance(value, (str, bool)):
        return value
    return float(value)


@pytest.fixture(scope="session")
def same_rows():
    """Whether a DataFrame and a DuckDB relation have equal rows, in any order."""

    def check(df, relation):
        names = sorted(df.columns)
        assert names == sorted(relation.columns)
        got = sorted(map(repr, (plain([r[n] for n in names]) for r in df.collect())))
        at = [relation.columns.index(n) for n in names]
        want = sorted(map(repr, (plain([r[i] for i in at]) for r in relation.fetchall())))
        assert got == want

    return check
