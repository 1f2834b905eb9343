from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

DATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from weftgraph.session import local_session

    home = tmp_path_factory.mktemp("spark")
    session = local_session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": f"file://{home}/shared"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.001")
