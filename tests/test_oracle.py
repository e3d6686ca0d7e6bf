"""Every registered query beside its SQL on the smallest driver tables."""

import os

import pytest

import checks.all_queries  # noqa: F401
from checks.base import ORACLES, QUERIES, Tables
from checks.run import compare, connect

FOLDER = os.environ.get("CHECK_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    n, verdict = compare(name, QUERIES[name](Tables(spark, FOLDER)), con)
    assert verdict in ("ok", "rows only"), verdict
    assert n > 0


def test_registry():
    assert set(ORACLES) <= set(QUERIES)
