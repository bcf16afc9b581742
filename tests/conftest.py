import glob
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"create view {os.path.basename(f)[:-8]} as from '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return c


def same(got, expected):
    """Two pandas tables hold the same rows, in any order, with the same columns."""
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    assert len(got) == len(expected)
    got, expected = (t[columns].sort_values(columns).reset_index(drop=True) for t in (got, expected))
    for c in columns:
        differ = ~((got[c] == expected[c]) | (got[c].isna() & expected[c].isna()))
        assert not differ.any(), (c, got[c][differ].head(3).tolist(), expected[c][differ].head(3).tolist())
