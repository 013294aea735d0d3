import math

import pytest

from __spark_entry__ import oracle_sql, queries
from conftest import SF01
from kestrel.llm.queries import ORACLE


def norm(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(shared, duck, name):
    df = queries()[name](shared, SF01)
    cols = sorted(df.columns)
    rel = duck.execute(oracle_sql()[name])
    at = {d[0]: i for i, d in enumerate(rel.description)}
    assert sorted(at) == cols
    want = sorted(str([norm(r[at[c]]) for c in cols]) for r in rel.fetchall())
    assert sorted(str([norm(r[c]) for c in cols]) for r in df.collect()) == want
