import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import pytest

from jobfacts.session import local_session


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("shared")
    session = local_session("4", "jobfacts-tests", **{"spark.checkpoint.dir": str(folder)})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def values(spark):
    """One column function over literal inputs."""

    def run(fn, inputs, kind="string"):
        from pyspark.sql import functions as F

        rows = [(i, x) for i, x in enumerate(inputs)]
        df = spark.createDataFrame(rows, f"i int, x {kind}")
        return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]

    return run


@pytest.fixture
def plan(spark):
    """The physical plan of a DataFrame as text."""
    import contextlib
    import io

    def text(df):
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain("formatted")
        return out.getvalue()

    return text
