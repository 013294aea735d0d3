"""Postings with block maxima against scoring every chunk; repeated rows; blocks that are skipped."""
import math
import random
import re

import pytest

from kestrel.operators import postings as PO

SCHEMA = "chunk_id string, doc_id string, text string"
QUERIES = [(0, "red fox jumps"), (1, "blue whale"), (2, "the the a"), (3, "nothing here matches zzz"), (4, "rare7 fox")]


def brute(rows, queries, k):
    chunks = {(c, t): d for c, d, t in rows if t is not None}
    bags = {}
    for c, t in chunks:
        words = re.findall(r"[^\W_]+", t.lower())
        if words:
            bags[c, t] = {w: words.count(w) for w in words}
    n = len(bags)
    out = []
    for q, text in queries:
        words = re.findall(r"[^\W_]+", text.lower())
        w = {t: words.count(t) * (math.log((1 + n) / (1 + sum(t in b for b in bags.values()))) + 1) for t in words}
        length = math.sqrt(sum(x * x for x in w.values()))
        scored = []
        for (c, t), bag in bags.items():
            s = sum(w[x] / length * bag[x] for x in w if x in bag) / math.sqrt(sum(x * x for x in bag.values()))
            if s > 0:
                scored.append((-round(s, 9), c))
        out += [(q, r + 1, c, round(-s, 6)) for r, (s, c) in enumerate(sorted(scored)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(4)
    words = ["the", "a", "fox", "red", "blue", "whale", "jumps", "sea"] + [f"w{i}" for i in range(200)]
    out = [(f"{i}-00", str(i), " ".join(rnd.choice(words) for _ in range(rnd.choice([2, 5, 9, 40])))) for i in range(600)]
    out += [("x-00", "x", "Red FOX jumps"), ("y-00", "y", "red fox jumps!"), ("y-00", "y", "another text of one id: fox"), ("r-00", "r", "rare7"), ("e-00", "e", " .!"), ("n-00", "n", None)]
    return out + [(f"h{i:03d}-00", "hot", "blue blue sea") for i in range(300)]


def found(index, k=3, **how):
    return sorted((r.query_id, r.rank, r.chunk_id, round(r.score, 6)) for r in PO.search(index, QUERIES, k, **how).collect())


def test_equals_scoring_every_chunk(spark, rows):
    index = PO.build(spark.createDataFrame(rows, SCHEMA).repartition(4), block_chunks=20)
    want = brute(rows, QUERIES, 3)
    assert found(index) == want and found(index, first=1) == want
    assert index.size() == len({(c, t) for c, _, t in rows if t and re.search(r"\w", t)})


def test_repeated_rows_change_nothing(spark, rows, tmp_path):
    once, twice = (PO.build(spark.createDataFrame(r, SCHEMA).repartition(4), block_chunks=50) for r in (rows, rows + rows))
    once.save(str(tmp_path / "index"))
    assert found(twice) == found(PO.load(spark, str(tmp_path / "index"))) == brute(rows, QUERIES, 3)


def test_blocks_are_skipped(spark, rows):
    index = PO.build(spark.createDataFrame(rows, SCHEMA), block_chunks=20)
    early, rest, _ = PO.visits(index, QUERIES[:2], 2)
    all_pairs = index.blocks.where("term in ('red', 'fox', 'jumps')").select("block").distinct().count()
    assert rest.where("query_id = 0").count() < all_pairs / 2
    # every block's maximum is its largest impact, and its number that of its postings
    bad = index.blocks.where("n <> size(postings) or top <> array_max(transform(postings, p -> p.impact))").count()
    assert bad == 0 and index.blocks.where("term = ''").agg({"n": "max"}).first()[0] <= 60


def test_empty_table(spark):
    assert found(PO.build(spark.createDataFrame([], SCHEMA))) == []


def test_written_index_serves_the_queries(spark, tmp_path):
    from __spark_entry__ import queries
    from conftest import SF001
    from kestrel.plans.retrieval_plans import INDEX_SETTING, write_text_index

    want = queries()["answer_key_topk"](spark, SF001).collect()
    write_text_index(spark, SF001, str(tmp_path / "texts"))
    try:
        assert sorted(queries()["answer_key_topk"](spark, SF001).collect()) == sorted(want)
    finally:
        spark.conf.unset(INDEX_SETTING + SF001)
