import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from bindery.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


# Started here because test modules build column expressions when imported.
SESSION = local_session(
    "4", "bindery-tests", **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bindery-tests-")}
)


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def evaluate(spark):
    """Values of a column expression over one string column ``v``."""

    def run(values, expression, kind="string"):
        rows = [(i, v) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, f"i int, v {kind}")
        found = df.select("i", expression.alias("r")).collect()
        return [r["r"] for r in sorted(found, key=lambda r: r["i"])]

    return run
