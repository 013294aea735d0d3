"""Driver contract: oracle keys are a subset of query keys, and every oracle runs in DuckDB
with unique, named columns."""
from __spark_entry__ import oracle_sql, queries


def test_oracle_keys_subset():
    q, o = queries(), oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 60


def test_oracles_run_with_unique_columns(duck):
    for name, sql in oracle_sql().items():
        rel = duck.execute(f"SELECT * FROM ({sql}) LIMIT 0")
        cols = [d[0] for d in rel.description]
        assert len(cols) == len(set(cols)), name
        assert all(c and "(" not in c for c in cols), (name, cols)
