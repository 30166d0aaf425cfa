import datetime as dt
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from growthgrain import GrowthFrames  # noqa: E402
from growthgrain.schemas import ACTIVITY, PAYMENTS, PROFILES, SUBSCRIPTIONS  # noqa: E402
from growthgrain.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        4,
        app="tests",
        **{"spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse"))},
    )
    yield session
    session.stop()


def day(text):
    return dt.date.fromisoformat(text) if text else None


def moment(text):
    return dt.datetime.fromisoformat(text).replace(tzinfo=dt.timezone.utc) if text else None


PROFILE_ROWS = [
    ("p1", "src_1", "US", "iOS", moment("2024-01-07T23:30")),
    ("p2", "src_1", "US", "Android", moment("2024-01-08T00:10")),
    ("p2", "src_2", "DE", "iOS", moment("2024-02-01T00:00")),
    ("p3", "src_1", "DE", "Web", moment("2024-01-10T12:00")),
    ("p4", "src_2", "US", "iOS", moment("2024-01-09T00:00")),
    ("p5", "src_2", None, "Android", moment("2024-01-09T00:00")),
    ("p6", None, "DE", "Android", None),
    (None, "src_2", "US", "iOS", moment("2024-01-15T00:00")),
]
PAYMENT_ROWS = [
    ("p1", day("2024-01-07"), 10.0),
    ("p1", day("2024-04-06"), 20.0),
    ("p1", day("2024-04-07"), 40.0),
    ("p2", day("2024-01-07"), 5.0),
    ("p2", day("2024-01-20"), 7.0),
    ("p4", day("2024-01-09"), None),
    ("p6", day("2024-02-01"), 3.0),
    ("p9", day("2024-01-20"), 100.0),
    (None, day("2024-01-16"), 2.0),
]
ACTIVITY_ROWS = [
    ("p1", day("2024-01-07")),
    ("p1", day("2024-01-14")),
    ("p1", day("2024-01-14")),
    ("p1", day("2024-02-06")),
    ("p2", day("2024-01-08")),
    ("p2", day("2024-02-14")),
    ("p3", day("2024-02-17")),
    ("p4", day("2024-01-08")),
    ("p5", day("2024-01-17")),
    ("p9", day("2024-01-20")),
    (None, day("2024-01-15")),
]


@pytest.fixture(scope="session")
def frames(spark):
    return GrowthFrames(
        spark.createDataFrame(PROFILE_ROWS, PROFILES),
        spark.createDataFrame(PAYMENT_ROWS, PAYMENTS),
        spark.createDataFrame(ACTIVITY_ROWS, ACTIVITY),
    )


# Monthly counts of the two subscription types, 2020-01 to 2024-11.
BASIC_START_END = {
    2020: (1001, 902),
    2021: (884, 911),
    2022: (881, 834),
    2023: (787, 815),
    2024: (849, 885),
}
PREMIUM_START_END = {
    2020: (542, 603),
    2021: (628, 701),
    2022: (723, 712),
    2023: (663, 720),
    2024: (749, 650),
}


@pytest.fixture(scope="session")
def subscriptions(spark):
    """The first and last month of each year, and the middle of 2024."""
    rows = []
    for name, years in (("Basic", BASIC_START_END), ("Premium", PREMIUM_START_END)):
        for year, (first, last) in years.items():
            rows.append((dt.date(year, 1, 1), name, first))
            rows.append((dt.date(year, 11 if year == 2024 else 12, 1), name, last))
    rows += [(dt.date(2024, 2, 1), "Basic", 880), (dt.date(2024, 3, 1), "Basic", 853)]
    return spark.createDataFrame(rows, SUBSCRIPTIONS)
