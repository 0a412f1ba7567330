import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture(scope="session")
def duck(data):
    import duckdb

    con = duckdb.connect()
    for p in Path(data).iterdir():
        con.sql(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM '{p}'")
    return con


def plain(frame):
    """Rows as sorted tuples of strings, columns by name, numbers rounded to 9 digits."""

    def value(x):
        if x is None or x != x:
            return "null"
        return f"{float(x):.9g}" if isinstance(x, (int, float, bool)) or hasattr(x, "dtype") and x.ndim == 0 else str(list(x)) if hasattr(x, "tolist") else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(value, row)) for row in frame.itertuples(index=False))


@pytest.fixture(scope="session")
def same(spark, data, duck):
    def check(query, sql):
        assert plain(query(spark, data).toPandas()) == plain(duck.sql(sql).df())

    return check
