"""One local session for all tests, and the comparison of Spark rows with DuckDB's."""

from __future__ import annotations

import math
import os
import sys

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}") + 0.0
    return tuple(map(_plain, v)) if isinstance(v, (list, tuple)) else v


def _order(row):
    return tuple((v is None, str(type(v)) if not isinstance(v, (int, float)) else "", v if v is not None else 0) for v in row)


@pytest.fixture(scope="session")
def same_as_sql():
    def check(df, sql, folder=SMALL):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
        columns = sorted(df.columns)
        got = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=_order)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == columns
        want = sorted((tuple(_plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=_order)
        assert got == want

    return check
