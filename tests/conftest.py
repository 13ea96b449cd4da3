from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from strataquill.session import local_session

    session = local_session(4, "4g", 4, "tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a Column expression over literals."""
    return lambda expression: spark.range(1).select(expression.alias("x")).first()["x"]
