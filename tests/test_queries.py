"""Every query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import pytest

from brindle.plans.catalogue import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)

    def plain(v):
        if v is None or v != v:
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(int(v)) if isinstance(v, (bool, int)) else str(v)

    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(name, spark, duck):
    got = QUERIES[name](spark, SF)
    want = duck(SF).execute(ORACLES[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(columns, want.fetchall())
