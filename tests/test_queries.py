"""Every registered query with an oracle equals DuckDB on sf0.01 (the driver's gate), plus the
entry smoke check on sf0.001.  Fitted-model queries (no oracle) are covered elsewhere."""
import math

import pytest

from __spark_entry__ import entry
from kestrel.plans import registry
from conftest import SF01

registry.load_all()

SLOW = {"forest_cv", "impurity_importance", "risk_model_scores", "model_report", "logreg_eval", "linear_head", "linear_head_report"}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return repr(v)


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 41
    assert df.columns == ["threshold", "f1", "recall", "precision"]


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SF01)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in cols) for r in df.collect())
    rel = duck.execute(registry.ORACLE[name])
    ocols = [d[0] for d in rel.description]
    assert sorted(ocols) == cols
    idx = {c: i for i, c in enumerate(ocols)}
    want = sorted(tuple(_norm(r[idx[c]]) for c in cols) for r in rel.fetchall())
    assert got == want


def test_every_query_has_rows(spark):
    for name, fn in registry.QUERIES.items():
        if name in SLOW or name in registry.ORACLE:
            continue
        assert fn(spark, SF01).count() >= 1, name
