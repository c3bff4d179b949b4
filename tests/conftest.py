import os
import sys

import duckdb
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2")
        .config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its DuckDB text on the smallest tables."""

    def check(query, sql):
        got = query(spark, TINY).toPandas()
        db = duckdb.connect()
        for name in os.listdir(TINY):
            db.execute(f"create view {name.removesuffix('.parquet')} as select * from '{TINY}/{name}'")
        want = db.execute(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        got, want = (x[columns].sort_values(columns).reset_index(drop=True) for x in (got, want))
        pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=1e-9)

    return check
