"""Every query with SQL against that SQL; the others must run and give rows."""

import os

import pytest

from labelloom.plans import catalog
from tests.compare import both, connection

FOLDER = os.environ.get("TEST_FOLDER", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    f = catalog.QUERIES[name]
    if name not in catalog.ORACLE_SQL:
        assert f(spark, FOLDER).count() >= 0
        return
    (columns, ours), (names, theirs) = both(spark, con, f, catalog.ORACLE_SQL[name], FOLDER)
    assert columns == names
    assert ours == theirs
