import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from tarmac.schema import FLIGHT_COLUMNS, FLIGHTS  # noqa: E402
from tarmac.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tarmac-tests",
        spark__master="local[*]",
        spark__sql__shuffle__partitions="8",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return SMALL


@pytest.fixture(scope="session")
def make_flights(spark):
    """Flights from partial dictionaries; unnamed cells take the defaults below."""
    defaults = dict.fromkeys(FLIGHT_COLUMNS) | {
        "month": 1,
        "op_unique_carrier": "AA",
        "origin": "ABE",
        "dest": "ATL",
        "cancelled": 0,
        "carrier_delay": 0.0,
        "weather_delay": 0.0,
        "nas_delay": 0.0,
        "security_delay": 0.0,
        "late_aircraft_delay": 0.0,
    }

    def make(rows):
        filled = [tuple({**defaults, **row}[c] for c in FLIGHT_COLUMNS) for row in rows]
        return spark.createDataFrame(filled, FLIGHTS)

    return make
