"""Every registered query against its SQL on the smallest tables; queries without SQL must at least give rows."""

import math

import pytest
from conftest import SF

from vecsift import registry


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.5f}".replace("-0.00000", "0.00000")
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in registry.ORACLE_SQL:
        assert got or name == "b5_cross_fit"
        return
    c = duck.execute(registry.ORACLE_SQL[name])
    names = [x[0] for x in c.description]
    assert sorted(names) == cols
    order = [names.index(x) for x in cols]
    assert got == sorted(tuple(plain(r[k]) for k in order) for r in c.fetchall())
