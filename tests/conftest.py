import os
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, os.environ.get("PYTHONPATH")]))  # for Python workers

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def agree(spark):
    """Asserts that a query and its SQL give the same rows on the tables of a folder."""

    def plain(v):
        return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v

    def rows(columns, found):
        order = sorted(range(len(columns)), key=lambda i: columns[i])
        return [columns[i] for i in order], sorted(map(repr, (tuple(plain(r[i]) for i in order) for r in found)))

    def check(query, sql, sf_dir=SMALL):
        con = duckdb.connect()
        con.execute("SET TimeZone = 'UTC'")
        for t in TABLES:
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
        df = query(spark, sf_dir)
        want = con.execute(sql)
        names, expected = rows([d[0] for d in want.description], want.fetchall())
        assert rows(df.columns, df.collect()) == (names, expected)

    return check
