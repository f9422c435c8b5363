import glob
import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def comparable(frame):
    """Rows of a pandas frame by column name, sorted, with floats rounded."""

    import pandas as pd

    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        if isinstance(v, bool) or type(v).__name__ == "bool_":
            return bool(v)
        return round(float(v), 6) if isinstance(v, (int, float)) or hasattr(v, "dtype") and not getattr(v, "shape", ()) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(v) for v in row) for row in frame.itertuples(index=False, name=None)), key=repr)
