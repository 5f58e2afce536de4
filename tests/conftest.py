import pytest
from pyspark.sql import SparkSession

from crosstally.session import LAUNCH_SETTINGS


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    base = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config(map=LAUNCH_SETTINGS)
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", str(base / "warehouse"))
        .config("spark.checkpoint.dir", str(base / "shared"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def frame(spark):
    """DataFrame from rows and DDL; numbers for DECIMAL columns may be given as text."""

    def make(rows, ddl):
        fields = [f.strip().split(" ", 1) for f in split_top(ddl)]
        text = spark.createDataFrame(
            [tuple(None if v is None else str(v) for v in r) for r in rows],
            ", ".join(f"`{n}` STRING" for n, _ in fields),
        )
        return text.selectExpr(*[f"CAST(`{n}` AS {t}) AS `{n}`" for n, t in fields])

    return make


def split_top(ddl):
    """Splits a DDL string at the commas outside parentheses."""
    parts, depth, start = [], 0, 0
    for i, c in enumerate(ddl):
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            parts.append(ddl[start:i])
            start = i + 1
    return [*parts, ddl[start:]]


@pytest.fixture
def values():
    """First column of a frame as a list."""
    return lambda df: [r[0] for r in df.collect()]
