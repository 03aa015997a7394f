"""Every registered query against its SQL twin."""

import pytest

import __spark_entry__ as entry
import check
from coreline.catalog import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    assert check.compare(spark, con, name, FOLDER) is None


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_random_intercept_at_other_sizes(spark, folder):
    assert check.compare(spark, check.database(folder), "lmm_random_intercept", folder) is None


def test_entry(spark):
    df = entry.entry(spark)
    # three types, and the cores of the site that the dimension doesn't know
    assert df.columns == ["site_type", "av", "sd", "n", "se"] and df.count() == 4


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
