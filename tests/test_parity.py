"""Every reference query with SQL against DuckDB on the smallest tables; the others against what must hold of them."""

import pytest

from opsloom import catalog
from tests.parity import compare, connect


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


#: What must hold of the queries that SQL cannot express.
HELD = {
    "logistic_classifier": lambda r: ((r.probability >= 0.5) == (r.label == 1)).mean() > 0.85,
    "root_cause_classifier": lambda r: r[r.kind == r.prediction]["n"].sum() > 0.85 * r["n"].sum(),
    "vector_index_search": lambda r: r["n_exact"].sum() >= 0.9 * r["n"].sum() > 0,
}


def test_every_query_is_held_to_something():
    assert set(catalog.QUERIES) == set(catalog.ORACLE) | set(HELD)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, con, name):
    df = catalog.QUERIES[name](spark, sf)
    if name in catalog.ORACLE:
        compare(df, con, catalog.ORACLE[name])
    else:
        assert HELD[name](df.toPandas()) and len(set(df.columns)) == len(df.columns)
