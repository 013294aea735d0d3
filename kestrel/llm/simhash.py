"""SimHash near-dedup by pigeonhole blocks.

Fingerprints are cut into ``b`` blocks.  Two that differ in at most ``d`` bits agree in ``b - d`` whole blocks
at least, so each fingerprint is filed under every choice of ``b - d`` blocks, and every pair of close ones
meets in a bucket, where the Hamming distance is verified.  ``b`` grows with the number of different
fingerprints so that a bucket key has more bits than there are fingerprints to tell apart: buckets hold
about one unrelated fingerprint at any corpus size, and every link is found with any ``b``.

Equal fingerprints are one node, so copies are never paired.  In a bucket, links come out as a spanning
forest (a breadth-first walk over the members not reached yet), never as all pairs.  A bucket over
``BUCKET`` members is split into parts, and every two parts meet in a bucket of their own.

Defined results: a null or empty text has fingerprint zero, linked like any other; a null ``doc_id`` is
never a component id unless all its component's ids are null; repeated rows are one component; other
columns are ignored; an empty table gives an empty result.
"""
from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.components import components
from kestrel.llm.shared import plain, written
from kestrel.llm.text import flat_bytes, slices

SHINGLE = 4
MAX_BITS = 4
SEED = 42
BUCKET = 4096
SHORT_RUN = 6


def fingerprints(raw: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """64-bit SimHash of each text: a bit is set where over half of the shingles' XXH64 have it set."""
    from xxhash import xxh64_intdigest

    low = [b" ".join(t.lower().split()) for t in raw]  # bytes.lower: A-Z only; split at ASCII white space only
    joined = b"\n".join([*low, b""])
    data = np.frombuffer(joined, np.uint8)
    size = np.fromiter(map(len, low), np.int64, len(low))
    closes = np.cumsum(size + 1) - 1  # the line feed after each text
    opens = closes - size
    gaps = np.flatnonzero((data == 0x20) | (data == 0x0A))
    ends = gaps
    starts = np.concatenate(([0], gaps[:-1] + 1))
    filled = ends > starts  # the place of a text without words is no word
    starts, ends = starts[filled], ends[filled]
    first = np.searchsorted(starts, opens)
    words = np.searchsorted(starts, closes) - first
    count = np.where(words == 0, 0, np.maximum(words - shingle + 1, 1))
    owner = np.repeat(np.arange(len(low)), count)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + first[owner]
    until = np.minimum(at + shingle, (first + words)[owner]) - 1
    hashes = np.fromiter((xxh64_intdigest(joined[s:e], seed) for s, e in zip(starts[at].tolist(), ends[until].tolist())), np.uint64, len(at))
    out = np.zeros(len(low), np.uint64)
    has = np.flatnonzero(count > 0)
    if not len(has):
        return out
    # eight byte lanes are summed at a time, at most 255 rows before they are widened
    parts = -(-count[has] // 255)
    part_owner = np.repeat(np.arange(len(has)), parts)
    part_no = np.arange(len(part_owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    cut = (np.cumsum(count[has]) - count[has])[part_owner] + 255 * part_no
    first_part = np.cumsum(parts) - parts
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(j)) & lanes, cut).view(np.uint8).reshape(-1, 8)
        per_text = np.add.reduceat(sums.astype(np.int64), first_part, axis=0)
        bits = (2 * per_text > count[has][:, None]).astype(np.uint64)
        for lane in range(8):
            out[has] |= bits[:, lane] << np.uint64(8 * lane + j)
    return out


def _fingerprints(batches, shingle: int):
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(1))
        raw = data.tobytes()
        fp = fingerprints([raw[a:b] for a, b in zip(offs[:-1], offs[1:])], shingle)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def block_masks(n: int, max_bits: int) -> list[int]:
    """Masks of every choice of blocks to agree in, for ``n`` different fingerprints."""
    blocks = max_bits + 1
    while 64 * (blocks - max_bits) / blocks < math.log2(max(n, 1)) + 1 and blocks < max_bits + 6:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    own = [(1 << hi) - (1 << lo) for lo, hi in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(own, blocks - max_bits)]


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among the members of one bucket."""
    rest, found_a, found_b = fps, [], []
    while len(rest) > 1:
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            x = frontier.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                new = rest[near]
                found_a.append(np.full(len(new), x))
                found_b.append(new)
                frontier.extend(new)
                rest = rest[~near]
    if not found_a:
        return fps[:0], fps[:0]
    return np.concatenate(found_a), np.concatenate(found_b)


def bucket_links(bucket: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of consecutive equal buckets: short runs by shifted comparison, long ones by ``forest``."""
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    size = np.diff(np.append(cut, len(fps)))
    short = np.repeat(size <= SHORT_RUN, size)
    a, b = [], []
    for shift in range(1, min(SHORT_RUN, len(fps))):
        at = np.flatnonzero((bucket[:-shift] == bucket[shift:]) & short[shift:])
        at = at[np.bitwise_count(fps[at] ^ fps[at + shift]) <= max_bits]
        a.append(fps[at])
        b.append(fps[at + shift])
    for i in np.flatnonzero(size > SHORT_RUN):
        x, y = forest(fps[cut[i]:cut[i] + size[i]], max_bits)
        a.append(x)
        b.append(y)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _links(batches, max_bits: int):
    """Rows sorted by bucket to links; a bucket cut by the end of a batch waits for the next one."""

    def out(key, fps):
        a, b = bucket_links(key, fps, max_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    held_key, held = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    held_cols = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [np.asarray(c) for c in batch.columns[:-1]]
        fps = np.asarray(batch.columns[-1]).view(np.uint64)
        if held_cols is not None:
            cols = [np.concatenate(x) for x in zip(held_cols, cols)]
            fps = np.concatenate([held, fps])
        change = np.zeros(len(fps), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        key = np.cumsum(change)
        whole = int(np.searchsorted(key, key[-1]))
        if whole:
            yield out(key[:whole], fps[:whole])
        held_cols, held, held_key = [c[whole:] for c in cols], fps[whole:], key[whole:]
    if len(held) > 1:
        yield out(held_key, held)


def links(fps: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all fingerprints of the one-column table ``fp`` (all different) that are close."""
    masks = block_masks(fps.count(), max_bits)
    filed = [F.struct(F.lit(i).alias("choice"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("masked")) for i, m in enumerate(masks)]
    keys = fps.select("fp", F.explode(F.array(*filed)).alias("k")).select("k.choice", "k.masked", "fp")
    large = keys.groupBy("choice", "masked").agg(F.count("*").alias("c")).filter(F.col("c") > bucket)
    large = written(large.select("choice", "masked", F.ceil(F.col("c") / bucket).cast("int").alias("parts")), "large-buckets")
    if large.isEmpty():
        split = keys.select("choice", "masked", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    else:
        own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
        pairs = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
        split = keys.join(large, ["choice", "masked"], "left").select("choice", "masked", "fp", F.coalesce(own, F.lit(0)).alias("own"), pairs.alias("other"))
        split = split.select("choice", "masked", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    dealt = split.repartition("choice", "masked", "i", "j").sortWithinPartitions("choice", "masked", "i", "j", "fp")
    return dealt.mapInArrow(lambda it: _links(it, max_bits), "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, fingerprint`` (16 hex digits), ``component_id``, the smallest id reachable."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    fps = written(plain(docs, "doc_id", "text").mapInArrow(lambda it: _fingerprints(it, shingle), f"doc_id {kind}, fp bigint"), "fingerprints")
    firsts = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct-fingerprints")
    close = links(firsts.select("fp"), max_bits, bucket)
    edges = close.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    groups = written(components(edges), "groups")  # by fingerprint; the smallest fingerprint names the group
    member = groups.select(F.col("node").alias("fp"), "component").unionByName(
        groups.select(F.col("component").alias("fp"), "component").distinct())
    grouped = firsts.join(member, "fp")
    lowest = grouped.groupBy("component").agg(F.min("first").alias("low"))
    named = firsts.join(member.join(lowest, "component").select("fp", "low"), "fp", "left").select("fp", F.coalesce("low", "first").alias("component_id"))
    named = written(named, "named-fingerprints")  # read anew, so that the join below can split a fingerprint of many copies
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
