"""One local session for all tests."""

import os
import sys
from pathlib import Path

import pytest
from comparing import by_sql, rows_of
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("OMP_NUM_THREADS", "1")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same_as_sql(spark):
    def check(query, sql, sf_dir):
        df = query(spark, str(sf_dir))
        names, rows = rows_of(df.columns, [tuple(r) for r in df.collect()])
        expected_names, expected = by_sql(sql, sf_dir)
        assert names == expected_names
        assert len(rows) == len(expected)
        assert rows == expected

    return check
