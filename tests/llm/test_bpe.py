import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from kestrel.llm.bpe import Encoder, Model, decode_ids, encode_documents, merge_one, read_ranks


@pytest.fixture(scope="module")
def ranks():
    return read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(4)
    letters = "abst'rvelmd  \n\t.!1 9éß'’ 漢😀LL'S  \x00"
    return ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)] + [
        "", "'", "''s", "it's they'RE we'll  x'lls 'sand", "a\n\n b", "   ", "x   ", "\n'd", "a" * 500, "#" * 3000 + " abc",
        "<|endoftext|>", "the " * 3000]


def test_ids_equal_library(ranks, library):
    encoder, rows = Encoder(Model(ranks)), texts()
    for part in (rows[:1000], rows[1000:], rows[:50]):  # the second and third meet cached slices
        ids, offs = encoder.encode(part)
        back, at = encoder.decode(ids, offs)
        for i, text in enumerate(part):
            assert ids[offs[i]:offs[i + 1]].tolist() == library.encode_ordinary(text)
            assert back[at[i]:at[i + 1]].tobytes() == text.encode()
    for text in rows[::100]:
        assert encoder.encode_exact(text).tolist() == library.encode_ordinary(text)


def test_documents(docs_of, ranks, library):
    rows = [(i, t) for i, t in enumerate(texts()[-40:])] + [(900, None), (None, "null id"), (901, "same"), (901, "same")]
    df = encode_documents(docs_of(rows), ranks, with_ids=True)
    want = sorted((str(i), len(ids := library.encode_ordinary(t or "")), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in df.collect()) == want
    by_id = {i: t for i, t in rows}
    for r in decode_ids(df, ranks).collect():
        assert bytes(r.decoded).decode() == (by_id[r.doc_id] or "")
        assert len(r.offsets) == len(r.ids) and (not r.ids or r.offsets[0] == 0)
    assert encode_documents(docs_of([]).limit(0), ranks).count() == 0


def test_long_slice(ranks, library):
    piece = "".join(random.Random(1).choice("abcd") for _ in range(700))
    assert merge_one(piece.encode(), ranks) == library.encode_ordinary(piece)
    assert np.array_equal(Encoder(Model(ranks)).encode([piece])[0], library.encode_ordinary(piece))
