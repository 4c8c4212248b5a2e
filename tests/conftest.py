import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session("local[8]", "tests", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("ckpt"))})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def days(start, n, step=1):
    d = dt.date.fromisoformat(start)
    return [d + dt.timedelta(days=i * step) for i in range(n)]


def weekdays(start, n):
    out, d = [], dt.date.fromisoformat(start)
    while len(out) < n:
        if d.weekday() < 5:
            out.append(d)
        d += dt.timedelta(days=1)
    return out


@pytest.fixture
def panel(spark):
    def make(series, dates):
        rows = [(s, d, None if v is None else float(v)) for s, values in series.items() for d, v in zip(dates, values)]
        return spark.createDataFrame(rows, "symbol string, dt date, close double")

    return make
