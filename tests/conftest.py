import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from turnwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tests", memory="6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def values(spark):
    """Evaluate named column expressions over literal rows; returns plain tuples in row order."""
    from pyspark.sql import functions as F

    def run(rows, schema, *columns):
        data = [(i, *r) for i, r in enumerate(rows)]
        df = spark.createDataFrame(data, f"__i int, {schema}")
        out = df.select("__i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy(F.col("__i")).collect()
        return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in out]

    return run
