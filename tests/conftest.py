import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[*]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.warehouse.dir", str(folder / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{folder}/shared")
        .getOrCreate()
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def matches():
    """Whether a DataFrame has the rows of DuckDB SQL."""
    import duckdb

    def check(df, sql, sf=SF):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
        want = con.sql(sql)
        names = sorted(want.columns)
        assert names == sorted(df.columns)
        rows = [tuple(r) for r in df.select(*names).collect()]
        assert sorted(map(repr, rows)) == sorted(map(repr, want.select(*[f'"{c}"' for c in names]).fetchall()))
        return rows

    return check
