"""One local session for all tests, and the tables that they read."""

from __future__ import annotations

import datetime
import decimal
import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("TZ", "UTC")
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir() -> str:
    return SMALL


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    """A value without the types of either engine; doubles to nine digits."""
    if v is None or v != v:
        return None
    if isinstance(v, (float, decimal.Decimal)):
        return float(f"{float(v):.9g}") + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def in_order(rows, columns) -> list[str]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted(repr([plain(r[i]) for i in at]) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, duck, sf_dir):
    """Holds a query's rows against those of its SQL."""

    def check(made: DataFrame, sql: str) -> None:
        want = duck.execute(sql)
        columns = [d[0] for d in want.description]
        assert sorted(made.columns) == sorted(columns)
        assert in_order([tuple(r) for r in made.collect()], made.columns) == in_order(want.fetchall(), columns)

    return check
