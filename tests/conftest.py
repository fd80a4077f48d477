import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[*]").appName("tallyloom-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def duck(sql: str, sf_dir: str = DATA):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return db.sql(sql).df()


def same_rows(spark_df, sql: str, sf_dir: str = DATA) -> None:
    import pandas as pd

    ours, theirs = spark_df.toPandas(), duck(sql, sf_dir)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert len(ours) == len(theirs)
    columns = sorted(ours.columns)

    def rows(df):
        def cell(x):
            if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x:
                return "null"
            return f"{x:.9g}" if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind in "fi" else str(x)

        return sorted(tuple(cell(x) if not isinstance(x, int) or isinstance(x, bool) else f"{x:.9g}" for x in r) for r in df[columns].itertuples(index=False))

    assert rows(ours) == rows(theirs)
