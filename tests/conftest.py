import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    from winnowlake.cluster import ship

    place = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[8]")
        .config(map={"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "4g", "spark.ui.enabled": "false", "spark.sql.warehouse.dir": str(place / "warehouse"), "spark.checkpoint.dir": f"file://{place / 'checkpoint'}"})
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield ship(s)
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(columns, data):
    """Rows as sorted tuples of comparable values, columns by name."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: "null" if v is None or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(str(plain(r[i])) for i in order) for r in data))


@pytest.fixture
def same(spark, sf, duck):
    def check(name):
        import __spark_entry__ as e

        df = e.queries()[name](spark, sf)
        found = duck.sql(e.oracle_sql()[name])
        assert sorted(df.columns) == sorted(found.columns)
        assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(found.columns, found.fetchall())

    return check
