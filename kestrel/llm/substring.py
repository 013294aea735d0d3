"""Substring dedup over the de Bruijn graph of the corpus' word sequences.

Edges are windows of ``k`` words (35).  Shuffling every edge would move many times the input, so
unbranched path pieces are compacted before anything is shuffled: consecutive edges of a document that
share their *minimizer* (the ``m``-word run of the smallest hash inside the window) form one piece.  Equal
edges share their minimizer wherever they stand, hence:

1. pieces are counted by minimizer; a minimizer met once holds no repeated edge and is dropped;
2. where all pieces of a minimizer are one word sequence, the path does not branch and every edge of
   the piece is repeated: decided without looking at edges;
3. where a minimizer joins different pieces (the path branches: the two ends of a repeat), pieces that
   occur twice are decided as wholes, and only the edges of the pieces left are compared by their hash,
   against each other and against one source of each piece that occurs twice;
4. coordinates (document, word) of all repeated edges go back to the documents, overlapping edges unite to
   spans, and the covered words are removed.

Pieces are identified by two 64-bit hashes (minimizer and words), single edges by two as well.

Defined results: a null text has no words; texts under ``k`` words lose nothing; a repeated row is a document
of its own, so its windows are found twice; rows with one ``doc_id`` and different texts stay apart (rows are
joined by id and text hash, nulls included); other columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, written
from kestrel.llm.text import Powers, flat_bytes, mix, prefix, slices, span_hash, word_hashes, word_spans

WINDOW = 35
MINIMIZER = 8


def sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the leftmost smallest value of every run of ``width`` values."""
    at = np.arange(len(values))
    span = 1

    def joined(a, shift):
        left, right = a[: len(a) - shift], a[shift:]
        return np.where(values[left] <= values[right], left, right)

    while 2 * span <= width:
        at = joined(at, span)
        span *= 2
    return joined(at, width - span) if span < width else at


def pieces(data, offs, k: int, m: int, pw: Powers):
    """Path pieces of the rows: (minimizer hash, words hash, row, first edge in the row, edges)."""
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    none = tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    if not (n_words >= k).any():
        return none
    pre = prefix(word_hashes(data, starts, ends, pw), pw)
    n = len(starts)
    runs = mix(span_hash(pre, np.arange(n - m + 1), np.arange(m, n + 1), pw))
    small = sliding_argmin(runs, k - m + 1)  # by the edge's first word
    row = np.repeat(np.arange(len(n_words)), n_words)[: len(small)]
    whole = np.arange(len(small)) + k <= first[1:][row]  # the edge ends inside its row
    at = np.flatnonzero(whole)
    cut = np.ones(len(at), bool)
    cut[1:] = (np.diff(at) > 1) | (small[at][1:] != small[at][:-1]) | (row[at][1:] != row[at][:-1])
    begin = at[cut]
    count = np.diff(np.append(np.flatnonzero(cut), len(at)))
    words = mix(span_hash(pre, begin, begin + count + k - 1, pw) + count.astype(np.uint64))
    return runs[small[begin]], words, row[begin], begin - first[row[begin]], count


def _pieces(batches, k: int, m: int):
    pw = Powers()
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(2))
        small, words, row, start, count = pieces(data, offs, k, m, pw)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [part.column(0).take(rows), part.column(1).take(rows), pa.array(small.view(np.int64)), pa.array(words.view(np.int64)),
             pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
            names=["doc_id", "th", "mini", "words", "start", "n"])


def covered(edges: np.ndarray, n_words: int, k: int) -> np.ndarray:
    """Which words the edges starting at ``edges`` cover."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, edges, 1)
    np.add.at(change, edges + k, -1)
    return np.cumsum(change[:-1]) > 0


def kept_sha(raw: bytes, edges: np.ndarray, k: int) -> tuple[int, int, str]:
    """(words, words removed, hash of the kept words joined by one space)."""
    words = raw.split()  # bytes split at exactly space and \t \n \v \f \r
    if len(edges):
        drop = covered(edges, len(words), k)
        kept = compress(words, ~drop)
        return len(words), int(drop.sum()), hashlib.sha256(b" ".join(kept)).hexdigest()
    return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()


PLACED = "doc_id {kind}, th int, text string, decided array<int>, edge array<int>, e1 array<bigint>, e2 array<bigint>, n_words bigint, n_removed bigint, kept_sha256 string"


def _placed(batches, k: int):
    """Documents with their pieces: finished where all is decided, else with the hashes of the open edges."""
    pw = Powers()
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(2))
        raw = data.tobytes()
        codes = part.column(3).to_pylist()
        out = {c: [] for c in ("text", "decided", "edge", "e1", "e2", "n_words", "n_removed", "kept_sha256")}
        for i, own in enumerate(codes):
            text = raw[offs[i]:offs[i + 1]]
            decided = edge = np.zeros(0, np.int64)
            if own:
                code = np.array(own, np.int64)
                start, n, flag = code >> 8, (code >> 2) & 63, code & 3
                every = np.concatenate([np.arange(s, s + c) for s, c in zip(start, n)])
                flag = np.repeat(flag, n)
                decided, edge = every[flag & 1 > 0], every[flag & 2 > 0]
            if len(edge):
                one = np.frombuffer(text, np.uint8)
                s, e, _ = word_spans(one, np.array([0, len(one)]))
                for name, seed in (("e1", 1), ("e2", 2)):
                    pre = prefix(word_hashes(one, s, e, pw, seed), pw)
                    out[name].append(mix(span_hash(pre, edge, edge + k, pw)).view(np.int64))
                row = (text.decode(), decided.astype(np.int32), edge.astype(np.int32), len(s), None, None)
            else:
                out["e1"].append(None)
                out["e2"].append(None)
                row = (None, None, None, *kept_sha(text, decided, k))
            for name, value in zip(("text", "decided", "edge", "n_words", "n_removed", "kept_sha256"), row):
                out[name].append(value)
        ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
        kinds = {"text": pa.string(), "decided": ints, "edge": ints, "e1": longs, "e2": longs, "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(out[c], kinds[c]) for c in kinds]],
                                         names=["doc_id", "th", *kinds])


def _finished(batches, k: int):
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(1))
        raw = data.tobytes()
        rows = []
        for i, (a, b) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
            edges = np.unique(np.array([*(a or ()), *(b or ())], np.int64))
            rows.append(kept_sha(raw[offs[i]:offs[i + 1]], edges, k))
        n, removed, sha = zip(*rows)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha)],
                                         names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def same_row(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["th"] == b["th"])


def remove_repeats(docs: DataFrame, k: int = WINDOW, m: int = MINIMIZER) -> DataFrame:
    """Remove the words covered by ``k``-word windows that start anywhere else too.

    One row per row of ``docs``: ``doc_id, n_words, n_removed, kept_sha256``.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    keyed = plain(docs, "doc_id", "text").select("doc_id", F.hash("text").alias("th"), "text")
    found = written(keyed.mapInArrow(lambda it: _pieces(it, k, m), f"doc_id {kind}, th int, mini bigint, words bigint, start int, n int"), "pieces")

    # aggregates are written before they are joined: read anew, both sides are shuffled, and Spark can split a
    # minimizer, piece or edge that very many documents hold
    minis = found.groupBy("mini").agg(F.count("*").alias("c"), F.min("words").alias("low"), F.max("words").alias("high")).filter("c > 1")
    minis = written(minis.select("mini", (F.col("low") != F.col("high")).alias("branches")), "minimizers")
    repeated = written(found.join(minis, "mini"), "repeats")

    at = F.struct("doc_id", "th", "start")
    types = (repeated.filter("branches").groupBy("mini", "words").agg(F.count("*").alias("c"), F.min(at).alias("source"))
             .select("mini", "words", (F.col("c") > 1).alias("twice"), "source"))
    types = written(types, "types")
    code = F.shiftleft(F.col("start").cast("bigint"), 8) + F.shiftleft(F.col("n"), 2)
    single = repeated.filter("not branches").select("doc_id", "th", (code + 1).alias("code"))
    branching = repeated.filter("branches").join(types, ["mini", "words"]).select(
        "doc_id", "th", (code + F.when(F.col("twice"), 1 + F.when(at.eqNullSafe(F.col("source")), 2).otherwise(0)).otherwise(2)).alias("code"))
    codes = single.unionByName(branching).groupBy("doc_id", "th").agg(F.collect_list("code").alias("codes"))

    joined = keyed.join(codes, same_row(keyed, codes), "left").select(keyed["doc_id"], keyed["th"], "text", "codes")
    placed = written(joined.mapInArrow(lambda it: _placed(it, k), PLACED.format(kind=kind)), "placed")

    open_edges = placed.filter("edge is not null").select(
        "doc_id", "th", F.explode(F.arrays_zip("edge", "e1", "e2")).alias("x")).select("doc_id", "th", "x.edge", "x.e1", "x.e2")
    twice = open_edges.groupBy("e1", "e2").agg(F.count("*").alias("c")).filter("c > 1").select("e1", "e2")
    twice = written(twice, "edges")
    hits = open_edges.join(twice, ["e1", "e2"]).groupBy("doc_id", "th").agg(F.collect_list("edge").alias("hits"))
    rest = placed.filter("edge is not null").select("doc_id", "th", "text", "decided")
    rest = rest.join(hits, same_row(rest, hits), "left").select(rest["doc_id"], "text", "decided", "hits")
    result = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    done = placed.filter("edge is null").select(*result)
    return done.unionByName(rest.mapInArrow(lambda it: _finished(it, k), f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string"))
