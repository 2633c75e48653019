"""Every query with an oracle statement gives the oracle's rows on the smallest tables."""

import pytest

from graphloom.plans import analysis_queries, data_queries, reference_queries
from verify import rows

MODULES = (data_queries, reference_queries, analysis_queries)
NAMES = [(m, n) for m in MODULES for n in m.QUERIES if n in m.ORACLE]


@pytest.mark.parametrize(("module", "name"), NAMES, ids=[n for _, n in NAMES])
def test_query_equals_oracle(spark, sf_dir, oracle, module, name):
    got = module.QUERIES[name](spark, sf_dir).toPandas()
    want = oracle.execute(module.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", [n for n in reference_queries.QUERIES if n not in reference_queries.ORACLE])
def test_query_runs(spark, sf_dir, name):
    df = reference_queries.QUERIES[name](spark, sf_dir)
    assert len(df.columns) == len(set(df.columns))
    df.count()
