"""Every registered query against its oracle SQL at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

from compare import compare, connect  # noqa: E402

from codesieve.plans import ORACLE, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    if not Path(SF).exists():
        pytest.skip("no test data")
    return connect(SF)


def test_all_have_oracles():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, name, SF) is None


def test_entry(spark):
    import __spark_entry__ as driver
    rows = driver.entry(spark).collect()
    assert rows and set(driver.oracle_sql()) <= set(driver.queries())
