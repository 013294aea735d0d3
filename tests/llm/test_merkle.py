import hashlib
import zlib

import pytest

from kestrel.llm.merkle import FANOUT, manifest


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain(rows):
    """The contract, tree by tree: rows of (doc_id, source, lang, n_chars, text)."""
    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([sha("".join(now[i:i + FANOUT])) for i in range(0, len(now), FANOUT)])
        return levels

    def way(levels, i):
        out = []
        for now in levels[:-1]:
            first = i // FANOUT * FANOUT
            out.append((now[first:i], now[i + 1:first + FANOUT]))
            i //= FANOUT
        return out

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    held = {g: sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r))) for g in names}
    trees = {g: tree([leaf(r) for r in held[g]]) for g in names}
    top = tree([trees[g][-1][0] for g in names])
    out = []
    for j, g in enumerate(names):
        for i, r in enumerate(held[g]):
            path = way(trees[g], i) + way(top, j)
            cut = zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 2 == 0 and r[4] is not None
            now = leaf((*r[:4], r[4].replace("\n", ""))) if cut else leaf(r)
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            proof = sha("".join("".join(a) + "".join(b) for a, b in path))
            out.append((r[0], leaf(r), trees[g][-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return sorted(out, key=str)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string"


def run(spark, rows, depth):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as pos", "1 as leaf", "1 as run", "1 as part", "1 as `a.b`")
    return sorted([tuple(r) for r in manifest(docs.repartition(3), depth).collect()], key=str)


@pytest.mark.parametrize("depth", [1, 6])
def test_equals_plain_trees(shared, depth):
    rows = [(i, "hot", "en", 5, f"a\nb{i}") for i in range(100)] + [(i, f"s{i % 7}", None, None, None if i % 3 else f"t{i}") for i in range(200, 240)]
    rows += [(None, None, None, None, None), (None, None, "x", 1, "a\nb"), (7, "hot", "en", 5, "a\nb7"), (300, "lone é", "de", 3, "ä\n" * 50000), (301, "", "", 0, ""), (302, "Z", "", 0, "\n")]
    got = run(shared, rows, depth)
    assert got == plain(rows)
    assert any(not r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 3, 4, 28])
def test_sizes_of_one_source(shared, n):
    rows = [(i, "s", "en", 1, f"x{i}\n") for i in range(n)]
    assert run(shared, rows, 1) == plain(rows)


def test_empty_table(shared):
    assert manifest(shared.createDataFrame([], SCHEMA)).collect() == []
