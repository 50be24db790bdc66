import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(map(_plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=repr)


def rows_of_sql(con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    at = [names.index(c) for c in sorted(names)]
    return sorted(names), sorted((tuple(_plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


@pytest.fixture(scope="session")
def same():
    def check(df, con, sql):
        names, got = rows_of(df)
        names2, want = rows_of_sql(con, sql)
        assert names == names2
        assert got == want

    return check


@pytest.fixture(scope="session")
def sf_dir():
    return SF
