import hashlib
import os

import public_tokenizers
import tiktoken

import corpus_pipeline
from kestrel.llm.bpe import read_ranks
from kestrel.llm.langid import identify
from kestrel.llm.lines import MIN_SITES
from llm.test_decontam import brute as contaminated
from llm.test_lines import brute as line_dedup
from llm.test_simhash import grouped, plain_fingerprint

SF = "/root/testdata/sf0.001"


def by_hand(rows, predicted, items):
    """The stages on Python rows (doc_id, text, source), each from its own definition."""
    rows = [r for r in rows if predicted[r[0]][0] != "und" and predicted[r[0]][1] >= 0.5]
    texts = {i: t for i, t, *_ in line_dedup(rows, MIN_SITES)}
    rows = [(i, texts[i]) for i, _, _ in rows]
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids = sorted(fps)
    groups = grouped([(a, b) for a in ids for b in ids if a < b and (fps[a] ^ fps[b]).bit_count() <= 4], ids)
    rows = [r for r in rows if groups[r[0]] == r[0]]
    bad = {hit[0] for hit in contaminated(rows, items)}
    return [r for r in rows if r[0] not in bad]


def test_stages_equal_brute_force(shared):
    docs = shared.read.parquet(f"{SF}/documents.parquet")
    predicted = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs).collect()}
    items = [tuple(r) for r in shared.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    want = by_hand(rows, predicted, items)
    assert len(want) < len(rows) - 10
    out = corpus_pipeline.run(shared, SF)
    ranks = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    expected = sorted((i, library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for i, t in want)
    assert sorted((r.doc_id, r.ids, r.decoded_sha256) for r in out.collect()) == expected


def test_stages_keep_columns_and_edge_rows(shared, tmp_path):
    long = " ".join(f"word{i}" for i in range(3000))
    rows = [(i, f"the text number {i} of this table {i * 7} has its own words {i * 13}", "en", "a", 5) for i in range(30)]
    rows += [(100, None, "en", "a", 0), (101, "", None, None, 0), (102, "1 2 3", "en", "b", 5), (103, long, "en", "b", 1), (103, long, "en", "b", 1),
             (104, "one id two texts alpha beta gamma delta", "en", "b", 1), (104, "entirely other words stand in this one here", "en", "b", 1), (None, "a text without an id", "en", "c", 1)]
    rows.append((105, "日本語の文章はここにあります。これは学習されていない文字です", None, "b", 5))  # of no learned language
    extra = ["gone_doc_id", "lang_pred", "score", "known", "n_removed", "N_Lines", "row", "c1", "a.b"]
    names = ["doc_id", "text", "lang", "source", "n_chars", *extra]
    docs = shared.createDataFrame([(*r, *extra) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"`{c}` string" for c in extra))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(shared, docs, SF)
        assert docs.columns == names
        path = str(tmp_path / os.urandom(4).hex())
        docs.write.parquet(path)
        docs = shared.read.parquet(path)
    assert all([r[c] for c in extra] == extra for r in docs.collect())
    left = sorted(str(r.doc_id) for r in docs.collect())
    assert left == sorted([*map(str, range(30)), "103", "104", "104", "None"])
    last = corpus_pipeline.STAGES[-1][1](shared, docs, SF)
    assert last.count() == len(left)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(shared, empty, SF)
        assert out.count() == 0
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None


