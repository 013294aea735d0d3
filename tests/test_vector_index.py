"""Blockwise search of a table of queries, exact and through cells, against brute force."""
import numpy as np
import pytest

from kestrel.operators import vector_index as VI

SCHEMA = "id long, doc string, embedding array<float>"


def rows_of(n, seed=5, dim=6, centres=12):
    rng = np.random.default_rng(seed)
    mid = rng.normal(size=(centres, dim)) * 3
    return [(i, f"d{i % 5}", [float(x) for x in np.float32(mid[i % centres] + rng.normal(size=dim) * 0.3)]) for i in range(n)]


def brute(rows, queries, k, exclude_self):
    dim = max(len(v) for _, _, v in rows if v)
    pad = lambda v: np.array((list(v) + [0.0] * dim)[:dim], float)
    held = [(i, d, pad(v)) for i, d, v in rows if v is not None and np.isfinite(np.array(v, float)).all()]
    out = []
    for q, v in queries:
        if v is None or not np.isfinite(np.array(v, float)).all():
            continue
        scored = sorted((-round(float(pad(v) @ w), 9), i, d) for i, d, w in held if not (exclude_self and i == q))[:k]
        out += [(q, r + 1, i, d, round(-s, 6)) for r, (s, i, d) in enumerate(scored)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.cand_id, r.cand_doc, round(r.score, 6)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus_rows():
    rows = rows_of(700)
    rows += [(1000 + i, "hot", rows[3][2]) for i in range(200)]  # one vector under many ids
    rows += [rows[8]] * 5  # a repeated row
    return rows + [(2000, "n", None), (2001, "n", [float("nan")] * 6), (2002, "n", [1.0, float("inf"), 0.0, 0.0, 0.0, 0.0]), (2003, "s", [2.0, 1.0]), (2004, "z", [0.0] * 6), (2005, "x", [1.0, None, 0.0, 0.0, 0.0, 0.0])]


@pytest.fixture(scope="module")
def index(spark, corpus_rows):
    return VI.build(spark.createDataFrame(corpus_rows, SCHEMA).repartition(4), part_rows=64)


def test_every_row_is_indexed(index):
    ids = [i for r in index.parts.select("ids").collect() for i in r.ids]
    assert sorted(ids) == sorted([*range(700), *range(1000, 1200), *[8] * 5, 2003, 2004])
    sizes = [len(r.ids) for r in index.parts.select("ids").collect()]
    assert max(sizes) < 64 * 2  # the hot cell is split
    for r in index.parts.collect():
        v = np.frombuffer(r.vectors).reshape(len(r.ids), -1)
        assert np.sqrt(((v - np.frombuffer(r["mean"])) ** 2).sum(axis=1)).max() <= r.radius + 1e-12


@pytest.mark.parametrize("block_rows", [None, 7])
def test_blocks_equal_brute_force(spark, index, corpus_rows, block_rows):
    queries = [(i, v) for i, _, v in corpus_rows[:700] if i % 20 == 0] + [(9000, [-1.0, 2.0]), (9001, None), (9002, [float("nan")] * 6), (9003, [0.0] * 6)]
    df = spark.createDataFrame(queries, "query_id long, embedding array<float>").repartition(3)
    got = found(VI.search(index, df, 3, exclude_self=True, block_rows=block_rows))
    assert got == brute(corpus_rows[:-1], queries, 3, True)


def test_bounds_skip_parts(corpus_rows, index):
    """With clustered vectors most parts are never multiplied."""
    seen = []

    class Sent:
        value = (np.arange(1), np.array([corpus_rows[0][2]], float), index.centres, np.array([float(np.array(corpus_rows[0][2]) @ np.array(corpus_rows[12][2]))]))

    real, VI.Best.add = VI.Best.add, lambda self, q, s, *a: (seen.append(s.size), real(self, q, s, *a))
    try:
        list(VI._visit(index.parts.select("cell", "mean", "radius", "ids", "docs", "vectors").toArrow().to_batches(), Sent, 3, False, None))
    finally:
        VI.Best.add = real
    assert sum(seen) < 300


def test_cells_reach_the_wanted_recall(spark, index, corpus_rows):
    corpus = spark.createDataFrame(corpus_rows, SCHEMA)
    probes = VI.choose_probes(index, corpus, 3)
    queries = corpus.where("id % 20 = 0 and id < 700").selectExpr("id as query_id", "embedding")
    exact, cells = VI.search(index, queries, 3, True), VI.search(index, queries, 3, True, probes=probes)
    assert probes < len(index.centres) and VI.recall(exact, cells).first().recall >= 0.9
    assert found(VI.search(index, queries, 3, True, probes=len(index.centres))) == found(exact)


def test_registered_recall(spark):
    from __spark_entry__ import queries
    from conftest import SF01

    assert queries()["vector_cells_recall"](spark, SF01).first().recall >= 0.9


def test_saved_index_and_empty_tables(spark, index, corpus_rows, tmp_path):
    index.save(str(tmp_path / "index"))
    again = VI.load(spark, str(tmp_path / "index"))
    queries = spark.createDataFrame([(i, v) for i, _, v in corpus_rows[:40]], "query_id long, embedding array<float>")
    assert found(VI.search(again, queries, 3)) == found(VI.search(index, queries, 3))
    none = spark.createDataFrame([], SCHEMA)
    assert VI.search(VI.build(none), queries, 3).collect() == []
    assert VI.search(index, queries.limit(0), 3).collect() == []
