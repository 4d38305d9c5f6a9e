import json
import sys
from datetime import datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from emberlog.schema import RAW_BATCH
from emberlog.session import build_session

NOW = datetime(2031, 8, 11, 12, 0, 0)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", spark__master="local[8]", spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false", spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def entry(**changes):
    """A valid entry; a field set to ``...`` is left out."""
    base = {
        "timestamp": "2031-08-11T11:58:30.000Z",
        "level": "error",
        "service": "mill",
        "message": "belt slipped twice",
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def envelope(*entries):
    return json.dumps({"logs": list(entries)})


@pytest.fixture
def batches(spark):
    def make(*bodies, received_at=NOW, prefix="b"):
        rows = [(f"{prefix}{i:04d}", received_at, body) for i, body in enumerate(bodies)]
        return spark.createDataFrame(rows, RAW_BATCH)

    return make
