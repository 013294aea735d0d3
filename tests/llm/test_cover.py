import math
import random

import numpy as np

from kestrel.llm.cover import Block, Found, hard_negatives, tree

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows):
    """The contract by brute force over (vec_id, embedding, label) rows."""
    dim = max((len(v) for _, v, _ in rows if v), default=0)
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own = [math.floor(256 * float(np.float32(x))) for x in v]
        held.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, own + [0] * (dim - len(own))))
    last = lambda i: (i is None, i or 0)
    out = []
    for a, (i, label, v) in enumerate(held):
        if i is None or i % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, other) for b, (j, other, w) in enumerate(held) if b != a), key=lambda t: (-t[0], last(t[1])))
        for p, j, _ in [t for t in scored if t[2] == label][:5]:
            near = [t for t in scored if t[2] != label and 30 * p <= 100 * t[0] <= 90 * p][:10]
            out += [(i, j, k + 1, t[1], p, t[0]) for k, t in enumerate(near)]
    return sorted(out, key=str)


def vectors(n, seed=3):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    return [(i, [c + rnd.gauss(0, 0.6) for c in centres[i % 4]], rnd.randrange(5)) for i in range(n)]


def run(spark, rows, **how):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as query", "1 as copies", "1 as `a.b`").repartition(3)
    return sorted([tuple(r) for r in hard_negatives(df, **how).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()], key=str)


def test_equals_brute_force(shared):
    rows = vectors(900)
    same = [rows[100][1]] * 40
    rows += [(2000 + i, v, 1 + i % 2) for i, v in enumerate(same)]  # one vector under many ids
    rows += [rows[200]] * 3 + [(300, rows[300][1], 2)]  # repeated rows, an id with two labels
    rows += [(None, rows[0][1], 0), (None, rows[400][1], 1), (5001, None, 1), (5002, [1.0, None, 1.0, 0.0, 0.0, 0.0], 1), (5003, [float("nan")] * 6, 1),
             (5004, [float("inf")] * 6, 2), (5005, [0.5] * 6, None), (5006, [0.5, 0.25], 2), (5100, [], 3), (5200, [0.0] * 6, 3), (5300, [-x for x in rows[0][1]], 4)]
    want = plain(rows)
    assert len(want) > 300
    assert run(shared, rows, block=200, leaf=4, group=4) == want
    assert run(shared, rows) == want


def test_few_rows_and_none(shared):
    rows = [(0, [1.0, 0.5], 0), (1, [1.0, 0.25], 1), (100, [0.75, 0.5], 1), (3, [0.5, 0.5], 0)]
    assert run(shared, rows) == plain(rows)
    assert run(shared, []) == []
    assert run(shared, [(1, [1.0], 1)]) == []


def test_large_components_saturate(shared):
    rows = [(0, [1e30, 1.0], 0), (7, [2e30, 0.0], 9), (1, [0.5, 1.0], 0), (2, [0.4, 0.0], 1)]
    got = run(shared, rows)
    assert all(-2 ** 53 <= r[4] <= 2 ** 53 for r in got)


def test_tree_covers_and_separates():
    points = np.random.default_rng(1).normal(size=(500, 5))
    order, nodes = tree(points, leaf=5)
    assert sorted(order) == list(range(500))
    leaves = np.zeros(500, int)
    for parent, centre, radius, start, end, small in nodes:
        d = np.sqrt(((points[order[start:end]] - points[centre]) ** 2).sum(axis=1))
        assert d.max() <= radius + 1e-9 and (parent < 0 or nodes[parent][3] <= start and end <= nodes[parent][4])
        leaves[start:end] += small
    assert (leaves == 1).all()


def test_descent_skips_nodes_and_stays_exact():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 4)) * 2000
    x = np.concatenate([c + rng.normal(size=(60, 4)) * 20 for c in centres]).astype(np.int32)
    ids, labels, copies = np.arange(len(x)), np.zeros(len(x), np.int64), np.ones(len(x), np.int64)
    packed = Block.build(ids, labels, copies, x)
    block = Block(4, {k: np.frombuffer(packed[k], t) for k, t in Block.FIELDS.items()})
    q = x[::100].astype(float)
    found = Found(q, np.ones(len(q), np.int64), np.full(len(q), -np.inf), np.full(len(q), np.inf), 10)
    seen = []
    verify = block._verify
    block._verify = lambda f, queries, s, e: (seen.append(len(queries) * (e - s)), verify(f, queries, s, e))
    block.search(found, False)
    scores = q @ x.T
    for i in range(len(q)):
        want = sorted(zip(-scores[i], ids))[:10]
        assert [(-s, j) for s, j in zip(found.scores[i], found.ids[i])] == want
    assert sum(seen) < 0.5 * scores.size
