"""Every query of the core that SQL can say, against that SQL; the others must run."""

import pytest

from tests.comparing import compare, connect
from tidemark.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = registry.queries(), registry.oracles()


@pytest.fixture(scope="module")
def tables():
    return connect(FOLDER)


def test_oracles_name_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, tables, name):
    compare(QUERIES[name](spark, FOLDER), tables, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    df = QUERIES[name](spark, FOLDER)
    assert df.columns and df.collect() is not None
