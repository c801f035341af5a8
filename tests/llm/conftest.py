import sys
from pathlib import Path

import pytest
from oracle import connect

ROOT = Path(__file__).resolve().parents[2]
sys.path[:0] = [str(ROOT)]


@pytest.fixture(scope="session")
def duck(folder):
    return connect(folder)


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs."""
    return lambda rows: spark.createDataFrame(list(rows), "doc_id long, text string")
