import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.dirname(os.path.abspath(__file__))) + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def same():
    """Compares a query with its SQL over the tables of a folder."""
    import datetime
    import glob

    import duckdb

    def plain(v):
        return f"{v:.9g}" if isinstance(v, float) else v.isoformat() if isinstance(v, (datetime.date, datetime.datetime)) else repr(v)

    def check(spark, f, sql, d):
        con = duckdb.connect()
        for path in glob.glob(f"{d}/*.parquet"):
            con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        df = f(spark, d)
        columns = sorted(df.columns)
        got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
        out = con.execute(sql)
        names = [x[0] for x in out.description]
        assert sorted(names) == columns
        want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in out.fetchall())
        assert got == want

    return check
