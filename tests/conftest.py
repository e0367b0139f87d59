import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame  # noqa: E402

SF_SMALL = os.environ.get("EPILAKE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from epilake.session import build_session
    s = build_session(master="local[4]", shuffle_partitions=4, app_name="epilake-tests")
    yield s
    s.stop()


class FakeBindings:
    """Bindings over inline DataFrames, for boundary tests of operators that take `b`."""

    def __init__(self, spark, geography=None, facility=None, climate=None, case=None):
        self.spark = spark
        self._g, self._f, self._c, self._k = geography, facility, climate, case

    def geography(self) -> DataFrame:
        return self._g

    def geography_b(self) -> DataFrame:
        return self._g

    def facility(self) -> DataFrame:
        return self._f

    def climate(self) -> DataFrame:
        return self._c

    def case(self) -> DataFrame:
        return self._k

    def geo_day_side(self, df: DataFrame) -> DataFrame:
        return df

    def derived(self, name, build) -> DataFrame:
        return build()


@pytest.fixture
def fake():
    return FakeBindings
