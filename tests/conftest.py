import pathlib
import sys
from datetime import datetime, timedelta, timezone

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))
sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent))

from barcast.session import local_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("*", 8)
    session.sparkContext.setLogLevel("ERROR")
    return session


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def slots(start: str, n: int) -> list[datetime]:
    return [utc(start) + timedelta(minutes=15 * i) for i in range(n)]


RAW = "ID string, ExecutionTime timestamp, high double, low double, close double, volume double, seq long"
BARS = "asset string, t timestamp, high double, low double, close double, volume double"


def series(asset: str, start: str, values: list[float], volume: list[float] | None = None) -> list[tuple]:
    """Bars whose measures all equal ``values`` (volume may differ)."""
    volume = volume or values
    return [(asset, t, v, v, v, w) for t, v, w in zip(slots(start, len(values)), values, volume)]
