import pytest
from oracle import both, connect

from quillgraph.plans import catalog


@pytest.fixture(scope="module")
def con(sf_small):
    return connect(sf_small)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, sf_small, con, name):
    ours, theirs = both(spark, catalog.QUERIES[name], catalog.ORACLES[name], sf_small, con)
    assert ours == theirs
    assert ours


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, sf_small, name):
    assert catalog.QUERIES[name](spark, sf_small).count() > 0
