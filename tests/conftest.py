import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [str(ROOT), os.environ.get("PYTHONPATH")]))
DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{shared}/ck").config("spark.sql.warehouse.dir", f"{shared}/wh").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _table(path: str) -> str:
    return f"{path}/*.parquet" if os.path.isdir(path) else path


@pytest.fixture(scope="session")
def duck():
    """A function of a data folder: a DuckDB connection with its tables as views."""
    import duckdb

    def connect(folder):
        c = duckdb.connect()
        for f in sorted(Path(folder).glob("*.parquet")):
            c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{_table(str(f))}')")
        return c

    return connect


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Compares a query's rows with its SQL's, whatever their order."""
    import __spark_entry__ as entry

    def check(name, folder):
        df = entry.queries()[name](spark, str(folder))
        names = sorted(df.columns)
        rel = duck(folder).execute(entry.oracle_sql()[name])
        of = [d[0] for d in rel.description]
        assert sorted(of) == names
        at = [of.index(n) for n in names]
        expected = sorted(tuple(str(r[i]) for i in at) for r in rel.fetchall())
        assert sorted(tuple(str(r[n]) for n in names) for r in df.collect()) == expected
        return len(expected)

    return check
