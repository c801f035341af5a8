import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from precolens.schemas import CADASTRO, COLETA  # noqa: E402
from precolens.session import local_session  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "precolens-tests")
    session.conf.set("spark.sql.maxMetadataStringLength", "10000")  # whole filter lists in plans
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return str(TESTDATA / "sf0.01")


@pytest.fixture
def fact(spark):
    """Fact table from rows given as dicts; columns left out are NULL."""

    def make(*rows):
        names = COLETA.fieldNames()
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLETA)

    return make


@pytest.fixture
def registry(spark):
    """Registry from (supplier code, product id, code, number) tuples."""
    return lambda *rows: spark.createDataFrame(list(rows), CADASTRO)
