import random

import numpy as np
import xxhash

from kestrel.llm.components import components
from kestrel.llm.simhash import block_masks, fingerprints, links, near_duplicates


def plain_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in low.translate({c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    runs = [" ".join(words[i:i + shingle]) for i in range(len(words) - shingle + 1)] or ([" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def grouped(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def corpus():
    rnd = random.Random(7)
    word = lambda: rnd.choice(["Of", "THE", "É", "x"]) if rnd.random() < 0.3 else f"w{rnd.randrange(3000)}"
    rows = [(i, " ".join(word() for _ in range(rnd.choice([1, 3, 4, 5, 40, 300, 700])))) for i in range(150)]
    for i in range(150, 320):
        words = rows[rnd.randrange(i)][1].split()
        for _ in range(rnd.randrange(3)):
            words[rnd.randrange(len(words))] = word()
        rows.append((i, "\n".join(words)))
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "a\x1cb c\x85d e f"), rows[3], rows[3]]


def test_fingerprints():
    rows = [t or "" for _, t in corpus()]
    assert fingerprints([t.encode() for t in rows]).tolist() == [plain_fingerprint(t) for t in rows]


def test_near_duplicates_equal_brute_force(docs_of):
    rows = corpus()
    fp = {}
    for i, t in rows:
        fp[i] = plain_fingerprint(t)
    ids = sorted(fp)
    close = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    want = grouped(close, ids)
    got = near_duplicates(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert all(r.fingerprint == f"{fp[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)
    assert len(set(want.values())) < len(want) - 20
    assert near_duplicates(docs_of([]).limit(0)).count() == 0


def test_links_of_dense_and_split_buckets(shared):
    rnd = random.Random(3)
    center = [rnd.getrandbits(64) for _ in range(3)]
    fps = {c for c in center}
    while len(fps) < 500:
        x = rnd.choice(center) if rnd.random() < 0.7 else rnd.choice(sorted(fps))
        for _ in range(rnd.randrange(1, 7)):
            x ^= 1 << rnd.randrange(64)
        fps.add(x)
    fps = sorted(fps)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    want = grouped([(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4], fps)
    df = shared.createDataFrame([(x,) for x in signed], "fp bigint")
    for bucket in (4096, 20):
        found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in links(df, 4, bucket).collect()]
        assert all((a ^ b).bit_count() <= 4 for a, b in found)
        assert grouped(found, fps) == want


def test_block_masks():
    rnd = np.random.default_rng(0)
    for n in (10, 10**5, 10**6, 10**9, 10**12):
        masks = block_masks(n, 4)
        for _ in range(200):
            x = 0
            for b in rnd.choice(64, 4, replace=False):
                x |= 1 << int(b)
            assert any(x & m == 0 for m in masks)


def test_components(shared):
    rnd = random.Random(5)
    edges = [(i, i - 1) for i in range(1, 60)] + [(200, i) for i in range(100, 199)] + [(rnd.randrange(300, 500), rnd.randrange(300, 500)) for _ in range(150)]
    nodes = sorted({x for e in edges for x in e})
    want = grouped(edges, nodes)
    df = shared.createDataFrame([(max(e), min(e)) for e in edges], "u bigint, v bigint")
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: c for n, c in want.items() if n != c}
