import zlib

import numpy as np

from conftest import SF01
from kestrel.llm.langid import LONGEST, SMOOTH, Model, fit, identify, remainder


def test_held_out_accuracy(shared):
    docs = shared.read.parquet(f"{SF01}/documents.parquet")
    rows = {r.doc_id: r for r in identify(docs).collect()}
    truth = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(truth) and all(0 <= r.score <= 1 for r in rows.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    held = [i for i, r in rows.items() if r.held_out]
    right = sum(rows[i].lang_pred == truth[i] for i in held)
    assert len(held) > 250 and right / len(held) > 0.97


def test_edge_rows(docs_of):
    rows = [(i, t) for i, t in enumerate(["the cat", "the dog", "le chat"] * 6)] + [(100, None), (101, ""), (102, "12 !!"), (103, "漢字"), (None, "the"), (103, "漢字"), (104, "the " * 100000)]
    got = {r.doc_id: (r.lang_pred, r.score) for r in identify(docs_of(rows)).collect()}
    assert got[100] == got[101] == got[102] == ("und", 0.0)
    assert got[103][0] == "en" and got[None][0] == "en" and got[104][0] == "en"
    assert identify(docs_of([]).limit(0)).count() == 0
    unlabelled = docs_of(rows).drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def test_scores_equal_plain_backoff():
    words = [(0, "the", 9), (0, "cat", 2), (1, "le", 8), (1, "chat", 3)]
    grams = {}
    for lang, w, c in words:
        p = f" {w} "
        for n in range(1, LONGEST + 1):
            for i in range(len(p) - n + 1):
                grams[lang, n, p[i:i + n]] = grams.get((lang, n, p[i:i + n]), 0) + c
    names = ["en", "fr"]
    model = Model(names, [(names[a], w, c) for a, w, c in words], [(names[a], n, g, c) for (a, n, g), c in grams.items()])
    total = [sum(c for a, _, c in words if a == k) for k in (0, 1)]
    known = {w for _, w, _ in words}

    def plain(word):
        if word in known:
            return [np.log((sum(c for a, w, c in words if a == k and w == word) + SMOOTH) / (total[k] + SMOOTH * len(known))) for k in (0, 1)]
        out, p = [0.0, 0.0], f" {word} "
        for i in range(len(p)):
            for n in range(LONGEST, 0, -1):
                g = p[i:i + n]
                if len(g) == n and ((0, n, g) in grams or (1, n, g) in grams):
                    kinds = {x for a, m, x in grams if m == n}
                    for k in (0, 1):
                        all_k = sum(c for (a, m, x), c in grams.items() if a == k and m == n)
                        out[k] += np.log((grams.get((k, n, g), 0) + SMOOTH) / (all_k + SMOOTH * len(kinds))) / n
                    break
        return out

    probe = ["the", "chats", "that", "xyz", "é", "lecat"]
    got = model.scores([np.array([ord(c) for c in w], np.uint32) for w in probe])
    assert np.allclose(got, [plain(w) for w in probe])


def test_fit_takes_only_its_rows(docs_of):
    docs = docs_of([(i, f"w{i}x") for i in range(30)])
    model = fit(docs.filter(remainder(docs["doc_id"]) != 1), sample=5)
    assert model.languages == ["en"] and model.words[0].size <= 5 * 2


def test_share_of_known_letters(docs_of):
    model = fit(docs_of([(i, t) for i, t in enumerate(["the cat sat", "the dog ran"] * 6)]))
    _, _, known = model.reader().predict(["the cat", "漢字 漢字", "the 漢", "", "theca"])
    assert known[0] == 1 and known[1] == 0 and known[2] == 0.75 and known[3] == 0 and 0 < known[4] < 1
