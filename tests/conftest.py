import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from kestrel.operators.features import write_order_features
    from kestrel.session import local_session

    s = local_session(cores="*", shuffle_partitions=8, app="kestrel-tests", shared=str(tmp_path_factory.mktemp("shared")))
    write_order_features(s, SF01, str(tmp_path_factory.mktemp("orders") / "sf0.01"))
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    from kestrel.sources.tables import TABLES

    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return con
