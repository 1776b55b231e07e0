import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from contactlake.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[8]", spark__sql__shuffle__partitions="4", spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__log__level="ERROR",
    )
    yield session
    session.stop()


@pytest.fixture
def evaluate(spark):
    """Rows of a literal table with extra columns computed by ``columns(row)``."""

    def run(schema, rows, **columns):
        frame = spark.createDataFrame(rows, schema)
        return [tuple(r) for r in frame.select(*[c.alias(n) for n, c in columns.items()]).collect()]

    return run
