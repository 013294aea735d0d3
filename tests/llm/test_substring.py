import hashlib
import random
import re
from collections import Counter

from kestrel.llm.substring import remove_repeats


def brute(rows, k):
    words = [re.findall("[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = Counter(tuple(w[i:i + k]) for w in words for i in range(len(w) - k + 1))
    out = []
    for (doc, _), w in zip(rows, words):
        drop = set()
        for i in range(len(w) - k + 1):
            if seen[tuple(w[i:i + k])] > 1:
                drop.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in drop)
        out.append((doc, len(w), len(drop), hashlib.sha256(kept.encode()).hexdigest()))
    return Counter(out)


def got(df):
    return Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in df.collect())


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: rnd.choice(["the", "of", "é", "ß", "x"]) if rnd.random() < 0.3 else f"w{rnd.randrange(400)}"
    gap = lambda: rnd.choice([" ", "\n", "  ", "\t"])
    passages = [[word() for _ in range(rnd.choice([34, 35, 36, 50, 90]))] for _ in range(8)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rnd.randrange(4)):
            parts += [word() for _ in range(rnd.randrange(60))]
            p = rnd.choice(passages)
            a, b = sorted((rnd.randrange(len(p) + 1), rnd.randrange(len(p) + 1)))
            parts += p if rnd.random() < 0.5 else p[a:b]
        rows.append((i, "".join(x + gap() for x in parts)))
    rows += [(i, rows[i - 200][1]) for i in range(200, 230)]
    rows += [(300, "a " * 200), (301, None), (302, ""), (303, " \n"), (304, "a " * 34), (None, "q " * 40), rows[5], rows[5], (6, rows[9][1])]
    return rows


def test_equals_brute_force(docs_of):
    for seed, k, m in ((1, 35, 8), (2, 12, 3), (3, 5, 5)):
        rows = corpus(seed)
        assert got(remove_repeats(docs_of(rows), k, m)) == brute(rows, k)


def test_empty_table(docs_of):
    assert remove_repeats(docs_of([]).limit(0)).count() == 0
