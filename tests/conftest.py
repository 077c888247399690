import sys
from datetime import datetime, timedelta
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from barloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def bars(spark):
    """Bars from (close, high, low, volume) lists or plain closes, one per day."""
    def make(closes, symbol="AAA", highs=None, lows=None, opens=None, volumes=None, start=datetime(2024, 1, 1)):
        rows = [(start + timedelta(days=i), symbol, float((opens or closes)[i]), float((highs or closes)[i]), float((lows or closes)[i]),
                 float(c), float((volumes or [1000] * len(closes))[i])) for i, c in enumerate(closes)]
        return spark.createDataFrame(
            rows, "timestamp timestamp_ntz, symbol string, open double, high double, low double, close double, volume double")
    return make


@pytest.fixture(scope="session")
def column():
    def values(df, name, order="timestamp"):
        return [r[0] for r in df.orderBy(order).select(name).collect()]
    return values
