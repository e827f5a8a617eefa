import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from embedlens.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", memory="4g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make(spark):
    """Rows ``id, vector`` from a list of vectors or of (id, vector)."""

    def build(rows, parts=3, kind="bigint"):
        pairs = [r if isinstance(r, tuple) else (i, r) for i, r in enumerate(rows)]
        data = [(i, None if v is None else [float(x) for x in v]) for i, v in pairs]
        return spark.createDataFrame(data, f"id {kind}, vector array<double>").repartition(parts)

    return build
