import random
import re

import public_tokenizers
import pytest

from kestrel.llm.unigram import BYTE_PENALTY, MARK, Counter, Model, count_tokens, log_probabilities, read_pieces


@pytest.fixture(scope="module")
def pieces():
    return read_pieces(public_tokenizers.path("piece_bpe_32k.model"))


def plain_count(text, logs, unknown):
    """Viterbi of each word by itself."""
    total, score = 0, 0.0
    for w in re.findall("[^\x20\x09-\x0D]+", text or ""):
        w = MARK + w
        best = [(0.0, 0)] + [(-float("inf"), 0)] * len(w)
        for i in range(1, len(w) + 1):
            for n in range(1, i + 1):
                p = w[i - n:i]
                gain, more = (logs[p], 1) if p in logs else (unknown * len(p.encode()), len(p.encode())) if n == 1 else (-float("inf"), 1)
                if best[i - n][0] + gain >= best[i][0] and gain > -float("inf"):
                    best[i] = (best[i - n][0] + gain, best[i - n][1] + more)
        total, score = total + best[-1][1], score + best[-1][0]
    return total, score


def texts():
    rnd = random.Random(6)
    alphabet = ["the", "an", "er", "é", "漢", "😀", "x", "Q", "!", " ", " ", "\n", "\t"]
    return ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(400)] + ["", " ", "a" * 300, "aé漢theX" * 90, "the " * 5000]


def test_equals_plain_viterbi(pieces):
    model = Model(pieces)
    logs = dict(zip(pieces, log_probabilities(len(pieces))))
    unknown = min(logs.values()) - BYTE_PENALTY
    counter = Counter(model)
    for part in (texts()[:200], texts()):
        words, tokens, score = counter.count(part)
        for i, t in enumerate(part):
            n, s = plain_count(t, logs, unknown)
            assert words[i] == len(re.findall("[^\x20\x09-\x0D]+", t)) and tokens[i] == n
            assert abs(score[i] - s) < 1e-6 * max(1, abs(s))


def test_documents(docs_of, pieces):
    rows = [(1, "the cat"), (2, None), (3, ""), (None, "a b"), (4, "same"), (4, "same")]
    got = sorted((str(r.doc_id), r.n_pretokens) for r in count_tokens(docs_of(rows), pieces).collect())
    assert got == [("1", 2), ("2", 0), ("3", 0), ("4", 1), ("4", 1), ("None", 2)]
    assert count_tokens(docs_of([]).limit(0), pieces).count() == 0
