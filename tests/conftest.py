import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*.parquet' if f.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same(spark, sf, duck):
    """Do a query and its SQL give the same rows and column names?"""

    def plain(v):
        if isinstance(v, float):
            return None if v != v else ("f", round(v, 6) + 0.0)
        return v

    def check(query, sql):
        df = query(spark, sf)
        names = sorted(df.columns)
        mine = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
        found = duck.sql(sql)
        assert sorted(found.columns) == names
        at = [found.columns.index(n) for n in names]
        theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
        assert mine == theirs

    return check
