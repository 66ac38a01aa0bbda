import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def normal(value):
    if isinstance(value, (list, tuple)):
        return tuple(normal(x) for x in value)
    if isinstance(value, float):
        return round(value, 6)
    return value


@pytest.fixture(scope="session")
def against_oracle(spark):
    """Compares a query with its SQL over a folder of tables, rows in any order."""
    import duckdb

    def check(sf_dir: str, query, sql: str) -> int:
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        got = query(spark, sf_dir)
        want = con.execute(sql)
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        a = sorted((normal(tuple(r)) for r in got.select(*names).collect()), key=repr)
        b = sorted((normal(r) for r in want.fetchall()), key=repr)
        assert a == b
        return len(a)

    return check
