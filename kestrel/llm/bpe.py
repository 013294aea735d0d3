"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding with offsets.

* Pre-tokenisation works on code-point classes.  Each character is a transition function on eight
  states (``transitions``); composition of such functions is associative, so the state before every
  character comes from a scan over blocks (compose inside blocks, scan the block functions, replay).
  No regular expression is run.
* The slices found are hashed; a slice not met before in the task is merged by rank, all new slices at
  a time (one leftmost lowest-rank merge per slice and round), and its ids are kept in a cache.
* Decoding gathers the bytes of the ids.  A row whose decoded bytes differ from its text (a clash of two
  slice hashes) is encoded again without the cache, so the round trip is exact.

Defined results: a null text is an empty text (no ids); empty texts have no ids; other columns of the
input are ignored; repeated rows give repeated results; an empty table gives an empty result.
"""
from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, ship, shipped
from kestrel.llm.text import (
    LETTER, NUMBER, SPACE, HashTable, Powers, byte_values, class_table, code_points, mix, prefix, ragged, slices, span_hash,
)

FRESH, IN_L, IN_N, IN_O, GLUE, IN_W, LEFT1, LEFT2 = range(8)
SYM_L, SYM_N, SYM_O, SYM_GLUE, SYM_W, SYM_LAST_W, SYM_APO1, SYM_APO2, SYM_END = range(9)
BLOCK = 256
#: What may follow an apostrophe as a token of its own.
SHORT_SUFFIXES, LONG_SUFFIXES = ("s", "t", "m", "d"), ("re", "ve", "ll")
LONG_SLICE = 128  # bytes; longer slices are merged one by one with a heap


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def transitions() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts a token) of each symbol and state."""
    step, start = np.zeros((9, 8), np.uint8), np.ones((9, 8), np.uint8)
    for symbol, state in ((SYM_L, IN_L), (SYM_N, IN_N), (SYM_O, IN_O)):
        step[symbol], start[symbol, [state, GLUE]] = state, 0
    step[SYM_GLUE], step[SYM_W], step[SYM_LAST_W], step[SYM_END] = GLUE, IN_W, IN_W, FRESH
    start[SYM_W, IN_W] = 0
    for symbol, after in ((SYM_APO1, LEFT1), (SYM_APO2, LEFT2)):
        step[symbol] = after
        step[symbol, [IN_O, GLUE]], start[symbol, [IN_O, GLUE]] = IN_O, 0
    for symbol in range(8):  # inside a suffix, whatever the character is
        step[symbol, LEFT1], step[symbol, LEFT2] = FRESH, LEFT1
        start[symbol, [LEFT1, LEFT2]] = 0
    return step, start


def symbols(cps: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The symbol of every code point; ``ends`` are the separator places that close the texts."""
    kind = classes[cps]
    kind[ends] = 255
    after = np.append(kind[1:], 255)
    nxt, nxt2 = np.append(cps[1:], 0), np.append(cps[2:], (0, 0))
    out = np.full(len(cps), SYM_O, np.uint8)
    out[kind == LETTER], out[kind == NUMBER] = SYM_L, SYM_N
    white = kind == SPACE
    closes = white & (after != SPACE) & (after != 255)  # the last of a run, a token follows
    out[white] = SYM_W
    out[closes] = SYM_LAST_W
    out[closes & (cps == 0x20)] = SYM_GLUE
    at = np.flatnonzero((cps == 0x27) & (kind != 255))
    if len(at):
        one, two = nxt[at], nxt2[at]
        follows, follows2 = after[at] != 255, np.append(kind[2:], (255, 255))[at] != 255
        out[at[follows & np.isin(one, [ord(c) for c in SHORT_SUFFIXES])]] = SYM_APO1
        for a, b in LONG_SUFFIXES:
            out[at[follows & follows2 & (one == ord(a)) & (two == ord(b))]] = SYM_APO2
    out[ends] = SYM_END
    return out


def token_starts(syms: np.ndarray) -> np.ndarray:
    """True where a token (or a separator) starts: an associative scan of the transition functions."""
    step, start = transitions()
    n = len(syms)
    cols = -(-n // BLOCK)
    padded = np.full(cols * BLOCK, SYM_END, np.uint8)
    padded[:n] = syms
    grid = np.ascontiguousarray(padded.reshape(cols, BLOCK).T)
    flat_step = step.ravel()
    whole = np.tile(np.arange(8, dtype=np.uint8), (cols, 1))  # each block's function
    for row in grid:
        whole = flat_step[row[:, None].astype(np.intp) * 8 + whole]
    jump = 1
    while jump < cols:  # inclusive scan of the block functions by doubling
        whole[jump:] = np.take_along_axis(whole[jump:], whole[:-jump].astype(np.intp), axis=1)
        jump *= 2
    state = np.full(cols, FRESH, np.uint8)
    state[1:] = whole[:-1, FRESH]
    out = np.empty((BLOCK, cols), np.uint8)
    flat_start = start.ravel()
    for i, row in enumerate(grid):
        at = row.astype(np.intp) * 8 + state
        out[i] = flat_start[at]
        state = flat_step[at]
    return out.T.ravel()[:n].astype(bool)


class Model:
    """A vocabulary of byte sequences with ranks, as arrays (bounded by the vocabulary; safe to broadcast)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        by_id = sorted((r, t) for t, r in ranks.items())
        size = by_id[-1][0] + 1
        self.length, joined, self.first = np.zeros(size, np.int64), [], np.zeros(size, np.int64)
        at = 0
        for r, t in by_id:
            self.length[r], self.first[r] = len(t), at
            at += len(t)
            joined.append(t)
        self.bytes = np.frombuffer(b"".join(joined), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs, merged = [], []
        for t, r in ranks.items():
            for i in range(1, len(t)):
                a, b = ranks.get(t[:i]), ranks.get(t[i:])
                if a is not None and b is not None:
                    pairs.append(a << 32 | b)
                    merged.append(r)
        self.pairs = HashTable()
        self.pairs.insert(np.array(pairs, np.uint64), np.array(merged, np.int64))
        decimal = [b"%d " % i for i in range(size)]
        self.dec = np.frombuffer(b"".join(decimal), np.uint8)
        self.dec_len = np.fromiter(map(len, decimal), np.int64, size)
        self.dec_first = np.cumsum(self.dec_len) - self.dec_len
        self.classes = class_table()
        pw = self.powers = Powers()
        ids = np.flatnonzero(self.length > 0)
        ends = self.first + self.length
        hashes = span_hash(prefix(byte_values()[self.bytes], pw), self.first[ids], ends[ids], pw)
        self.whole = HashTable()
        self.whole.insert(mix(hashes + self.length[ids].astype(np.uint64)), ids)
        self.kept, self.powers = None, Powers()

    def pair_ranks(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        got = self.pairs.find((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64))
        return np.where(got < 0, none, got)

    def encoder(self) -> Encoder:
        """One encoder for all tasks of a Python worker (a worker keeps its broadcast values)."""
        if self.kept is None:
            self.kept = Encoder(self)
        return self.kept


def merge_one(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge one slice with a heap: O(n log n), for slices of any length."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def push(i):
        j = nxt[i]
        if j < n:
            rank = ranks.get(piece[i:end[j]])
            if rank is not None:
                heapq.heappush(heap, (rank, i, end[j]))

    for i in range(n):
        push(i)
    while heap:
        _, i, e = heapq.heappop(heap)
        if not alive[i] or nxt[i] >= n or end[nxt[i]] != e:
            continue
        j = nxt[i]
        alive[j] = False
        end[i], nxt[i] = e, nxt[j]
        if nxt[j] < n:
            prev[nxt[j]] = i
        push(i)
        if prev[i] >= 0:
            push(prev[i])
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = nxt[i]
    return out


def merge_many(data: np.ndarray, first: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids) of many slices ``data[first:first+length]``, merged together round by round."""
    count = len(first)
    pw = model.powers
    pre = prefix(byte_values()[data], pw)
    rank = model.whole.find(mix(span_hash(pre, first, first + length, pw) + length.astype(np.uint64)))
    # a hash decides nothing alone: the bytes of the token found must be those of the slice
    found = np.flatnonzero((rank >= 0) & (model.length[rank] == length))
    size = length[found]
    same = np.add.reduceat((data[ragged(first[found], size)] == model.bytes[ragged(model.first[rank[found]], size)]).astype(np.int64),
                           np.cumsum(size) - size) == size if len(found) else np.zeros(0, bool)
    found = found[same]
    owners, done = [found], [rank[found]]
    rest = np.ones(count, bool)
    rest[found] = False
    for i in np.flatnonzero(rest & (length > LONG_SLICE)):
        ids = merge_one(data[first[i]:first[i] + length[i]].tobytes(), model.ranks)
        owners.append(np.full(len(ids), i))
        done.append(np.array(ids, np.int64))
        rest[i] = False
    left = np.flatnonzero(rest)
    sym = model.single[data[ragged(first[left], length[left])]]
    size = length[left].copy()
    none = np.int64(1) << 40
    rank = None
    while len(left):
        begin = np.cumsum(size) - size
        if rank is None:
            rank = model.pair_ranks(sym[:-1], sym[1:], none)
            rank = np.append(rank, none)
            rank[begin + size - 1] = none
        low = np.minimum.reduceat(rank, begin)
        ended = low == none
        if ended.any():
            out = np.repeat(ended, size)
            owners.append(np.repeat(left[ended], size[ended]))
            done.append(sym[out])
            sym, rank = sym[~out], rank[~out]
            left, size, low = left[~ended], size[~ended], low[~ended]
            if not len(left):
                break
            begin = np.cumsum(size) - size
        hit = np.flatnonzero(rank == np.repeat(low, size))
        owner = np.searchsorted(begin, hit, side="right") - 1
        at = hit[np.append(True, owner[1:] != owner[:-1])]  # the leftmost of each slice
        sym[at] = low
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        sym, rank = sym[keep], rank[keep]
        at -= np.arange(len(at))  # where the merged symbols are now
        size -= 1
        begin = np.cumsum(size) - size
        ends = begin + size - 1
        inner = at[at < ends]
        rank[inner] = model.pair_ranks(sym[inner], sym[inner + 1], none)
        rank[at[at == ends]] = none
        inner = at[at > begin]
        rank[inner - 1] = model.pair_ranks(sym[inner - 1], sym[inner], none)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(done)[order], np.bincount(owner, minlength=count)


class Encoder:
    """Encodes lists of texts; the slices met so far in the task are cached."""

    CACHE = 1 << 19  # slices kept; a full cache is emptied (the results stay the same)

    def __init__(self, model: Model):
        self.model, self.powers = model, model.powers
        self._empty()

    def _empty(self):
        self.table = HashTable(16)
        self.ids, self.first, self.length, self.n_ids, self.n = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0, 0

    def _add(self, keys, ids, lens):
        while self.n_ids + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.n + len(lens) > len(self.first):
            self.first, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.first, self.length))
        self.ids[self.n_ids:self.n_ids + len(ids)] = ids
        self.first[self.n:self.n + len(lens)] = self.n_ids + np.cumsum(lens) - lens
        self.length[self.n:self.n + len(lens)] = lens
        self.table.insert(keys, np.arange(self.n, self.n + len(lens)))
        self.n += len(lens)
        self.n_ids += len(ids)

    def slices_of(self, texts: list[str]):
        """(code points, starts, ends, text number) of all pre-tokens of the texts."""
        cps, offs = code_points(texts)
        ends_at = offs[1:] - 1
        syms = symbols(cps, ends_at, self.model.classes)
        starts = np.flatnonzero(token_starts(syms))
        ends = np.append(starts[1:], len(cps))
        real = syms[starts] != SYM_END
        starts, ends = starts[real], ends[real]
        return cps, starts, ends, np.searchsorted(ends_at, starts)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them)."""
        if self.n > self.CACHE:
            self._empty()
        cps, starts, ends, owner = self.slices_of(texts)
        keys = span_hash(prefix(mix(cps.astype(np.uint64) + np.uint64(7)), self.powers), starts, ends, self.powers)
        keys = mix(keys + (ends - starts).astype(np.uint64))
        word = self.table.find(keys)
        new = np.flatnonzero(word < 0)
        if len(new):
            fresh, at = np.unique(keys[new], return_index=True)
            at = new[at]
            data = np.frombuffer("\x00".join([*texts, ""]).encode(), np.uint8)
            upto = np.zeros(len(cps) + 1, np.int64)  # byte places of the code points
            np.cumsum(1 + (cps > 0x7F) + (cps > 0x7FF) + (cps > 0xFFFF), out=upto[1:])
            first = upto[starts[at]]
            ids, lens = merge_many(data, first, upto[ends[at]] - first, self.model)
            self._add(fresh, ids, lens)
            word[new] = self.table.find(keys[new])
        size = self.length[word]
        ids = self.ids[ragged(self.first[word], size)]
        per_text = np.bincount(owner, weights=size, minlength=len(texts)).astype(np.int64) if len(word) else np.zeros(len(texts), np.int64)
        return ids, np.concatenate(([0], np.cumsum(per_text)))

    def encode_exact(self, text: str) -> np.ndarray:
        """Ids of one text without the cache."""
        cps, starts, ends, _ = self.slices_of([text])
        out = [i for s, e in zip(starts, ends)
               for i in merge_one(cps[s:e].astype("<u4").tobytes().decode("utf-32-le").encode(), self.model.ranks)]
        return np.array(out, np.int32)

    def decode(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes of all ids, offsets of the texts in them)."""
        size = self.model.length[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.model.bytes[ragged(self.model.first[ids], size)], upto[offs]

    def decimals(self, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(decimal ids, each followed by a space, as bytes; offsets of the texts in them)."""
        size = self.model.dec_len[ids]
        upto = np.concatenate(([0], np.cumsum(size)))
        return self.model.dec[ragged(self.model.dec_first[ids], size)], upto[offs]


def sha(data: np.ndarray) -> str:
    return hashlib.sha256(memoryview(np.ascontiguousarray(data))).hexdigest()


def _encoded(batches, broadcast, with_ids: bool):
    encoder = shipped(broadcast).encoder()
    for part in slices(batches, "text"):
        texts = [t or "" for t in part.column(part.schema.get_field_index("text")).to_pylist()]
        ids, offs = encoder.encode(texts)
        out_bytes, out_offs = encoder.decode(ids, offs)
        raw = [t.encode() for t in texts]
        digits, digit_offs = encoder.decimals(ids, offs)
        n, ids_sha, dec_sha, ids_out = [], [], [], []
        for i, source in enumerate(raw):
            own, plain_bytes = ids[offs[i]:offs[i + 1]], out_bytes[out_offs[i]:out_offs[i + 1]]
            text_ids = digits[digit_offs[i]:max(digit_offs[i], digit_offs[i + 1] - 1)]
            if plain_bytes.tobytes() != source:
                own = encoder.encode_exact(texts[i])
                one = np.array([0, len(own)])
                plain_bytes, text_ids = encoder.decode(own, one)[0], encoder.decimals(own, one)[0][:-1]
            n.append(len(own))
            ids_sha.append(sha(text_ids))
            dec_sha.append(sha(plain_bytes))
            if with_ids:
                ids_out.append(own)
        cols = [part.column(part.schema.get_field_index("doc_id")), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(dec_sha)]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if with_ids:
            cols.append(pa.array(ids_out, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(cols, names=names)


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], with_ids: bool = False) -> DataFrame:
    """Encode and decode every whole ``text``; one row per input row: ``doc_id, n_tokens, ids_sha256,
    decoded_sha256`` and, if asked for, the ``ids`` themselves.  The vocabulary (of fixed size) is broadcast;
    nothing is shuffled."""
    model = ship(docs.sparkSession, Model(ranks))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return plain(docs, "doc_id", "text").mapInArrow(lambda it: _encoded(it, model, with_ids), schema)


def decode_ids(df: DataFrame, ranks: dict[bytes, int], column: str = "ids") -> DataFrame:
    """Bytes of an ids column as ``decoded`` and the byte offset of each id as ``offsets``; null ids give null."""
    table = df.sparkSession.sparkContext.broadcast({r: t for t, r in ranks.items()})

    @F.pandas_udf("struct<decoded: binary, offsets: array<bigint>>")
    def decoded(ids):
        import pandas as pd

        rows = []
        for row in ids:
            if row is None:
                rows.append((None, None))
                continue
            pieces = [table.value[int(i)] for i in row]
            lens = np.cumsum([0, *map(len, pieces)])[:-1]
            rows.append((b"".join(pieces), lens.astype(np.int64)))
        return pd.DataFrame(rows, columns=["decoded", "offsets"])

    return df.select("*", decoded(F.col(f"`{column}`")).alias("_d")).select(*[F.col(f"`{c}`") for c in df.columns], "_d.decoded", "_d.offsets")
