"""Every query of the core against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from papyrine.plans import registry
from run_query import canonical, connect, oracle

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables here")
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(DATA)


#: What SQL has no form of: compatibility normal forms, JSON at any depth, similarity by matching blocks.
NO_SQL = {"q_nfkc", "q_redact_json", "q_canonical_json", "q_section_resolve", "q_contract"}


def test_each_has_sql():
    assert set(QUERIES) == set(SQL) | NO_SQL and not NO_SQL & set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), oracle(duck, SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)
