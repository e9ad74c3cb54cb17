from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    import os

    os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parents[1]}:{os.environ.get('PYTHONPATH', '')}"
    from corpusloom.session import local_session

    session = local_session(4, "tests", checkpoint_dir="file://" + str(tmp_path_factory.mktemp("shared")), **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
