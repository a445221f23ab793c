import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    tmp = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.warehouse.dir", str(tmp / "warehouse"))
        .config("spark.checkpoint.dir", str(tmp / "checkpoints"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


POINTS = "sid bigint, clock bigint, value double, quality int, seq bigint"


@pytest.fixture(scope="session")
def points(spark):
    """points(rows, more columns...) of (sid, clock, value, quality, seq)."""

    def make(rows, ddl=POINTS):
        return spark.createDataFrame([tuple(r) for r in rows], ddl)

    return make


def rows(df, *cols):
    return sorted([tuple(r) for r in (df.select(*cols) if cols else df).collect()], key=lambda r: [(x is None, str(type(x)), x if x is not None else 0) for x in r])
