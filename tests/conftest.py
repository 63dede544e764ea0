import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from starloom.session import get_spark  # noqa: E402

TESTDATA = "/root/testdata"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = get_spark(
        "tests",
        {
            "spark.master": "local[8]",
            "spark.driver.memory": "8g",
            "spark.log.level": "ERROR",
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": str(folder / "checkpoint"),
            "spark.sql.warehouse.dir": str(folder / "warehouse"),
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """Scale factor -> DuckDB connection with the given tables as views."""

    def connect(sf):
        connection = duckdb.connect()
        for table in TABLES:
            connection.execute(
                f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/sf{sf}/{table}.parquet'"
            )
        return connection

    return connect
