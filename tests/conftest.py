import os
import sys
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4")
               .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
               .config("spark.python.sql.dataFrameDebugging.enabled", "false")
               .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def utc(text):
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def make_bars(n, start="2024-01-02T14:30:00", minutes=5, symbol="ES", seed=1, base=4000.0):
    """Deterministic bars with quarter-point prices."""
    import random

    rng = random.Random(seed)
    price, rows = base, []
    for i in range(n):
        open_ = price
        price = max(price + rng.choice([-1.0, -0.5, -0.25, 0.0, 0.25, 0.5, 1.0]), 1.0)
        high, low = max(open_, price) + 0.25 * rng.randint(0, 3), min(open_, price) - 0.25 * rng.randint(0, 3)
        rows.append((symbol, utc(start) + timedelta(minutes=minutes * i), open_, high, low, price, rng.randint(1, 50)))
    return rows


BAR_SCHEMA = "symbol string, ts_event timestamp, open double, high double, low double, close double, volume long"


@pytest.fixture(scope="session")
def bars(spark):
    """Two symbols of 400 five-minute bars; ES has half a day's hole in it."""
    rows = [r for i, r in enumerate(make_bars(400)) if not 150 <= i < 200] + make_bars(120, symbol="CL", seed=2, base=70.0)
    return spark.createDataFrame(rows, BAR_SCHEMA).cache()


def records(df, *keys):
    """Rows as dicts in key order, floats rounded."""
    out = [{k: (round(v, 9) + 0.0 if isinstance(v, float) else v) for k, v in r.asDict().items()} for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys))
