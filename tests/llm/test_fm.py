import zlib

import numpy as np
import pyarrow as pa

from conftest import SF01
from kestrel.llm.fm import BINS, WORDS, Machine, Reader, fit, quality, train


def reader(texts):
    return Reader().read(pa.array(texts), pa.array([float(len(t)) for t in texts]))


def test_held_out_accuracy(shared):
    docs, labels = (shared.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[r.doc_id].score, r.quality) for r in labels.collect() if rows[r.doc_id].held_out]
    good, bad = [s for s, q in held if q], [s for s, q in held if not q]
    assert len(bad) > 3 and np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.97
    assert np.mean([(s >= 0.3) == q for s, q in held]) > 0.95


def test_sum_of_squares_equals_all_pairs():
    rng = np.random.default_rng(0)
    weights = rng.normal(size=(WORDS + 17 * BINS, 4))
    machine = Machine([np.array([0.1, 1.0, 3.0])] * 17, weights, 0.3)
    offs, places, values = machine.rows(*reader(["one two two\nthree #x 1", "", "A a B"]))
    got = machine.raw(offs, places, values)
    for r in range(3):
        p, x = places[offs[r]:offs[r + 1]], values[offs[r]:offs[r + 1]]
        v = weights[p, :-1]
        pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(len(p)) for j in range(i))
        assert np.isclose(got[r], 0.3 + weights[p, -1] @ x + pairs)


def test_machine_learns_an_interaction():
    # the label is the exclusive or of two words: no linear machine separates it
    texts = [f"{a} {b}" for a in ("p", "q") for b in ("r", "s")] * 60
    labels = np.array([(t in ("p r", "q s")) * 1.0 for t in texts])
    row, place, value, stats = reader(texts)
    edges = [np.zeros(0)] * stats.shape[1]
    machine = train(*Machine(edges, None, 0).rows(row, place, value, stats), labels, edges, epochs=60)
    raw = machine.raw(*machine.rows(row, place, value, stats))
    assert ((raw > 0) == labels).all()


def test_statistics_of_a_text():
    text = "Aa aa b\nline\n\nline\n#1 Aa aa b"
    _, _, value, stats = reader([text, "", "word " * 100000])
    s = dict(zip(__import__("kestrel.llm.fm", fromlist=["x"]).STATISTICS, stats[0]))
    assert np.isclose(np.expm1(s["words"]), 9) and np.isclose(np.expm1(s["lines"]), 4) and s["repeated_lines"] == 0.25
    assert np.isclose(s["distinct_words"], 4 / 9) and np.isclose(s["distinct_triples"], 6 / 7) and np.isclose(s["top_word"], 4 / 9)
    assert np.isclose(s["symbols"], 1 / len(text)) and s["n_chars_off"] == 0
    assert np.isfinite(stats).all()


def test_edge_rows(shared, docs_of):
    rows = [(i, f"good text number {i} here" if i % 2 else "### $$$ %%%") for i in range(60)] + [(None, "good text"), (100, None), (101, ""), (102, "\n \n"), (103, "x" * 300000), (3, "good text number 3 here")]
    docs = docs_of(rows).selectExpr("*", "cast(length(text) as bigint) n_chars", "1 as place", "1 as score", "1 as `a.b`", "2 as quality")
    labels = shared.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(1, 1, 0), (2, None, 0), (None, 1, 0), (7000, 1, 0)], "doc_id bigint, quality int, place int")
    out = quality(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({(r.score, r.predicted) for r in out if r.doc_id == 3}) == 1
    assert quality(docs.limit(0), labels).collect() == []
    one = quality(docs, labels.filter("quality = 1")).collect()
    assert {r.predicted for r in one} == {1} and len({r.score for r in one}) == 1
    assert {r.score for r in quality(docs, labels.limit(0)).collect()} == {0.5}


def test_fit_takes_a_bounded_sample(shared, docs_of):
    docs = docs_of([(i, f"w{i}") for i in range(300)]).selectExpr("*", "1L as n_chars")
    labels = shared.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, quality int")
    seen = []

    def spy(offs, *rest, **how):
        seen.append(len(offs) - 1)
        return train(offs, *rest, **how)

    import kestrel.llm.fm as fm
    fm.train, old = spy, fm.train
    try:
        fit(docs, labels, sample=20, epochs=1)
    finally:
        fm.train = old
    assert seen == [40]
