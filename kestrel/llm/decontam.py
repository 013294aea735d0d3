"""Benchmark decontamination by template windows.

Words are lower-cased, stripped of outer punctuation and *canonicalised*: a word with a digit becomes the
placeholder of a number, a unit after a number the one of a unit, a capitalised word inside a sentence the
one of a name.  As names also open sentences, and copies are re-wrapped or change their case, both sides are read in
two more ways: every capitalised word is a name, and no word is one; and where names stand side by side, in two more, a
run of them in one line is one name (Maria Lopez for Tom).  They add matches where the first way finds none; the windows of an item
are counted in the first.  Windows of ``window`` canonical words (templates) of benchmark items and documents are joined
by their 128-bit hash; a template needs ``literals`` words that are no placeholders.  Every match also carries
its slots, the surface forms behind the placeholders, and the slot check asks that one slot value of the item
stands for one value in the document.  A document is contaminated by an item if it holds at least ``share`` of
the item's windows and at least that share of its matched slot values are consistent; so re-parameterised
questions are caught, and chance meetings of placeholders are not.  Where a document holds an item more than once,
with other values each time, one occurrence that passes by itself is enough: the matches of one shift (place in the
document less place in the item), or of the shifts of a stretch as long as the item (two grids, half of it apart),
so that words put in or left out do not cut an occurrence.

An item none of whose windows has enough literal words (a few words, mostly numbers or names) has no template that would tell
it from chance: it is matched by its surface windows, word for word with its numbers and names.

Items of one template (equal windows and equal slot patterns in the first way that has windows) form a class.  Documents are matched with
classes, whose windows are those of all their items, so that many documents and many items of one template give a row
for each document and not one for each pair; ``item_classes`` has the members.

Documents are first sieved by a bit table made from the benchmark's windows and sized to their number, up to 32 MB: what it
lets through by chance does not survive the join, and nothing that matches is lost.  The join itself is a plain
equi-join, so a large benchmark is shuffled, not broadcast.

Defined results: null or empty texts hold no windows; an item under ``window`` words is one window of its own
length (null items and those of one or two words match nothing); repeated rows and items give
one hit; rows (and items) with one id, or null, and different texts stay apart; other columns are ignored; an empty
table on either side gives no hits.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, without, written
from kestrel.llm.text import Powers, flat_bytes, mix, prefix, slices, span_hash, word_hashes, word_spans

WINDOW = 8
LITERALS = 4
SHARE = 0.5
SIEVE_BITS, SIEVE_MOST, SIEVE_SPARSE = 1 << 22, 1 << 28, 32  # least and most bits of the sieve, and bits for each window between them
#: Units of measure that are a slot after a number.
UNITS = ("mm", "cm", "m", "km", "in", "ft", "mg", "g", "kg", "lb", "ml", "l", "s", "sec", "min", "h", "hr", "days", "weeks", "years",
         "miles", "meters", "metres", "hours", "minutes", "seconds", "dollars", "euros", "cents", "percent", "usd", "eur", "kmh", "mph", "degrees")
NUMBER, UNIT, NAME = 1, 2, 3
RUNS = 4  # added to a way: runs of names are one name
SURFACE, SURFACE_WORDS = 3, 3  # the way of items without a template, and the fewest words of such an item
SHIFT, OUTER = 32, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def byte_table(chars) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


def canonical(data: np.ndarray, offs: np.ndarray, pw: Powers):
    """Words of the rows: (placeholder kinds in each of the three ways, surface hash, second hash, whether nothing but
    white space parts the word from the one before in its line, each row's first word)."""
    starts, ends, _ = word_spans(data, offs)
    outer = byte_table(OUTER)[data]
    place = np.arange(len(data))
    inner_before = np.maximum.accumulate(np.where(outer, -1, place)) if len(data) else place
    inner_after = np.minimum.accumulate(np.where(outer, len(data), place)[::-1])[::-1] if len(data) else place
    s, e = inner_after[starts], inner_before[ends - 1] + 1
    real = s < e  # a word of punctuation only is no word
    closes = byte_table(b".!?")[data[ends - 1]] if len(ends) else np.zeros(0, bool)
    row = np.searchsorted(offs, starts, side="right") - 1
    after_stop = np.append(True, closes[:-1]) if len(closes) else closes
    line = np.concatenate(([0], np.cumsum(data == 10)))
    new_line = np.ones(len(starts), bool)
    new_line[1:] = (line[starts[1:]] != line[starts[:-1]]) | (row[1:] != row[:-1])
    bare = np.zeros(len(starts), bool)
    bare[1:] = (s[1:] == starts[1:]) & (e[:-1] == ends[:-1]) & (row[1:] == row[:-1])
    s, e, row, opens, bare = s[real], e[real], row[real], (after_stop | new_line)[real], bare[real]
    low = data.copy()
    upper = (data >= 65) & (data <= 90)
    low[upper] += SHIFT
    h1, h2 = word_hashes(low, s, e, pw, 1), word_hashes(low, s, e, pw, 2)
    digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))
    uppers = np.concatenate(([0], np.cumsum(upper)))
    kind = np.zeros(len(s), np.uint8)
    number = digits[e] > digits[s]
    kind[number] = NUMBER
    capital = ~number & upper[s] & (uppers[e] - uppers[s] == 1) if len(s) else number
    units = np.frombuffer("".join(UNITS).encode(), np.uint8)
    size = np.fromiter(map(len, UNITS), np.int64, len(UNITS))
    upto = np.cumsum(size)
    after_number = np.append(False, number[:-1] & (row[1:] == row[:-1])) if len(s) else number
    kind[after_number & ~number & np.isin(h1, word_hashes(units, upto - size, upto, pw, 1))] = UNIT
    kinds = [np.where(names & (kind == 0), np.uint8(NAME), kind) for names in (capital & ~opens, capital, np.zeros(len(s), bool))]
    return kinds, h1, h2, bare & ~opens, np.searchsorted(row, np.arange(len(offs)))


def labels(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word, the place in its row at which a word of its hash first stands."""
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if not len(h):
        return np.zeros(0, np.int64)
    _, at, back = np.unique(mix(h + mix(row.astype(np.uint64))), return_index=True, return_inverse=True)
    return at[back] - first[:-1][row]


def ways(words, item: bool, pw: Powers):
    """(way, (canonical hash, second hash, kind, slot value, each row's first word), each word's place among all words,
    words of which a window of the way holds one, kind by which its literals are counted too): a window that two ways
    read alike is the first's.  The slot value of an item's word is its label, of a document's its surface hash."""
    kinds, h1, h2, bare, first = words
    place = np.arange(len(h1))
    value = labels(h1, first) if item else h1.view(np.int64)
    for way, kind in enumerate(kinds):
        c1, c2 = h1.copy(), h2.copy()
        for k in (NUMBER, UNIT, NAME):
            c1[kind == k], c2[kind == k] = mix(np.array([k], np.uint64))[0], mix(np.array([k + 10], np.uint64))[0]
        yield way, (c1, c2, kind, value, first), place, kind != kinds[0] if way else None, kinds[0] if item else kind
        if way == len(kinds) - 1:
            return
        goes_on = np.zeros(len(kind), bool)
        goes_on[1:] = bare[1:] & (kind[1:] == NAME) & (kind[:-1] == NAME)
        if goes_on.any():
            # a run stands at the place and with the slot value of its last word, as a window that starts there has it
            ends = ~np.append(goes_on[1:], False)
            last, upto = place[ends], np.concatenate(([0], np.cumsum(ends)))[first]
            yield (way + RUNS, (c1[last], c2[last], kind[last], value[last], upto), last, goes_on[last],
                   kinds[0][last] if item else kind[last])


def surface(words):
    """The words as they are, as a reading without placeholders; its hashes are its own."""
    _, h1, h2, _, first = words
    salt = np.uint64(SURFACE << 40)
    return mix(h1 + salt), mix(h2 + salt), np.zeros(len(h1), np.uint8), h1.view(np.int64), first


def windows(canon, pw: Powers, size: int, literals: int, holds=None, counted=None):
    """All windows of ``size`` words with enough literals: (first hash, second hash, row, first word)."""
    c1, c2, kind, _, first = canon
    n = len(c1)
    if n < size:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.arange(n - size + 1)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    words = np.concatenate(([0], np.cumsum(kind == 0)))
    at = at[(at + size <= first[1:][row]) & (words[at + size] - words[at] >= min(literals, size))]
    if holds is not None:
        held = np.concatenate(([0], np.cumsum(holds)))
        at = at[held[at + size] > held[at]]
    if counted is not None:
        words = np.concatenate(([0], np.cumsum(counted == 0)))
        at = at[words[at + size] - words[at] >= min(literals, size)]
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))[at]
    return (mix(span_hash(prefix(c1, pw), at, at + size, pw) + np.uint64(size)),
            mix(span_hash(prefix(c2, pw), at, at + size, pw) + np.uint64(size)), row, at)


def slots(canon, at: np.ndarray, size: int) -> list[np.ndarray]:
    """Slot values of the placeholders of each window, in order."""
    _, _, kind, value, _ = canon
    return [value[a:a + size][kind[a:a + size] > 0] for a in at]


SIDE = "id {kind}, w1 bigint, w2 bigint, at int, slots array<bigint>, way int, n int"


def _batch(ids, row, w1, w2, at, found, way, n):
    return pa.RecordBatch.from_arrays(
        [ids.take(pa.array(row)), pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), pa.array(at.astype(np.int32)), pa.array(found, pa.list_(pa.int64())),
         pa.array(np.full(len(at), way, np.int32)), pa.array(np.full(len(at), n, np.int32))],
        names=["id", "w1", "w2", "at", "slots", "way", "n"])


def _item_windows(batches, size: int, literals: int):
    pw = Powers()
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(1))
        words = canonical(data, offs, pw)
        first = words[-1]
        count = np.diff(first)
        told = np.zeros(len(count), bool)  # items with a template
        for way, canon, place, holds, counted in ways(words, True, pw):
            own_count = np.diff(canon[-1])
            shorter = np.unique(own_count[(own_count < size) & (own_count >= literals)]).tolist()
            for n in (size, *shorter):
                w1, w2, row, at = windows(canon, pw, n, literals, holds, counted)
                own = (own_count[row] == n) | (n == size)
                w1, w2, row, at = w1[own], w2[own], row[own], at[own]
                told[row] = True
                yield _batch(part.column(0), row, w1, w2, place[at] - first[row], slots(canon, at, n), way, n)
        canon = surface(words)
        for n in np.unique(np.minimum(count[~told & (count >= SURFACE_WORDS)], size)).tolist():
            w1, w2, row, at = windows(canon, pw, n, 0)
            own = ~told[row] & (np.minimum(count, size)[row] == n)
            w1, w2, row, at = w1[own], w2[own], row[own], at[own]
            yield _batch(part.column(0), row, w1, w2, at - first[row], slots(canon, at, n), SURFACE, n)


def passes(sieve: dict, w1: np.ndarray) -> np.ndarray:
    place = (w1.view(np.uint64) >> np.uint64(sieve["shift"])).astype(np.int64)
    return sieve["bits"][place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1 > 0


def _doc_windows(batches, size: int, literals: int, sieve):
    pw = Powers()
    table = {**sieve.value, "bits": np.frombuffer(sieve.value["bits"], np.uint8)}
    sizes = table["sizes"]
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(1))
        words = canonical(data, offs, pw)
        first = words[-1]
        for way, canon, place, holds, _ in ways(words, False, pw):
            for n in sizes:
                w1, w2, row, at = windows(canon, pw, n, literals, holds)
                own = passes(table, w1)
                w1, w2, row, at = w1[own], w2[own], row[own], at[own]
                if len(at):
                    yield _batch(part.column(0), row, w1, w2, place[at] - first[row], slots(canon, at, n), way, n)
        canon = surface(words)
        for n in table["surface"]:
            w1, w2, row, at = windows(canon, pw, n, 0)
            own = passes(table, w1)
            w1, w2, row, at = w1[own], w2[own], row[own], at[own]
            if len(at):
                yield _batch(part.column(0), row, w1, w2, at - first[row], slots(canon, at, n), SURFACE, n)


def _sieve(items: DataFrame, size: int) -> dict:
    """A bit table with the places of all benchmark windows, gathered by place (rows of 4 KB, one for each 32,768 bits at most)."""
    want, bits = items.count() * SIEVE_SPARSE, SIEVE_BITS
    while bits < min(want, SIEVE_MOST):
        bits *= 2
    shift = 64 - bits.bit_length() + 1
    place = F.shiftrightunsigned(F.col("w1"), shift)
    blocks = (items.select(place.alias("p")).groupBy(F.expr("p div 32768").alias("block"))
              .agg(F.collect_set(F.expr("cast(p % 32768 as int)")).alias("inside")))
    packed = np.zeros(bits // 8, np.uint8)
    for row in blocks.toLocalIterator():
        inside = np.zeros(32768, np.uint8)
        inside[row["inside"]] = 1
        packed[row["block"] * 4096:(row["block"] + 1) * 4096] = np.packbits(inside)
    lengths = items.select("n", (F.col("way") == SURFACE).alias("surface")).distinct().collect()  # at most twice ``size`` rows
    return {"bits": packed.tobytes(), "shift": shift, "sizes": sorted(r["n"] for r in lengths if not r["surface"]) or [size],
            "surface": sorted(r["n"] for r in lengths if r["surface"])}


def _keyed(rows: DataFrame, id_col: str) -> DataFrame:
    """``id`` (the id and the text's hash) and ``text``."""
    return plain(rows, id_col, "text").select(F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("text")).alias("id"), "text")


def _item_side(benchmark: DataFrame, window: int, literals: int) -> tuple[DataFrame, DataFrame]:
    """The windows of the items, and of each item with windows its class: ``member, item`` (the class's smallest), ``n_items, words``."""
    rows = _keyed(benchmark, "item_id")
    kind = rows.schema["id"].dataType.simpleString()
    items = rows.mapInArrow(lambda it: _item_windows(it, window, literals), SIDE.format(kind=kind))
    items = written(items.dropDuplicates(["id", "at", "way"]), "benchmark-windows")
    words = rows.mapInArrow(_lengths, f"own {kind}, words int").dropDuplicates(["own"])
    # equal sets of windows with their places and slot labels, in the first way with windows
    window_hash = [F.bit_xor(F.xxhash64(F.lit(salt), "at", "w1", "w2", "slots", "n")) for salt in (1, 2)]
    by_way = items.groupBy("id", "way").agg(F.struct(F.col("way"), F.count(F.lit(1)), *window_hash).alias("sig"))
    signed = by_way.groupBy("id").agg(F.min_by("sig", "way").alias("sig")).join(words, F.col("id").eqNullSafe(F.col("own"))).drop("own")
    signed = written(signed, "benchmark-signatures")
    classes = signed.groupBy("sig").agg(F.min("id").alias("item"), F.count(F.lit(1)).alias("n_items"), F.max("words").alias("words"))
    return items, written(signed.select(F.col("id").alias("member"), "sig").join(written(classes, "benchmark-classes"), "sig").drop("sig"), "class-members")


def item_classes(benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS) -> DataFrame:
    """Of each item that can match its class: ``item_id, class_item_id`` (the one that ``contaminated`` names) and ``n_items``; items with
    one id and different texts have a row each."""
    return _item_side(benchmark, window, literals)[1].select(F.col("member.id").alias("item_id"), F.col("item.id").alias("class_item_id"), "n_items")


def _contaminated(docs: DataFrame, benchmark: DataFrame, window: int, literals: int, share: float) -> DataFrame:
    """``contaminated`` with the keys of ``_keyed`` as ``doc`` and ``item``."""
    spark = docs.sparkSession
    own = _keyed(docs, "doc_id")
    doc_kind = own.schema["id"].dataType.simpleString()
    items, members = _item_side(benchmark, window, literals)
    sieve = spark.sparkContext.broadcast(_sieve(items, window))
    found = written(own.mapInArrow(lambda it: _doc_windows(it, window, literals, sieve), SIDE.format(kind=doc_kind)), "sieved-windows")

    items = items.join(members, F.col("id").eqNullSafe(F.col("member"))).groupBy("item", "w1", "w2", "at", "slots", "way").agg(
        F.max("words").alias("words"), F.max("n_items").alias("n_items"))
    items = written(items, "class-windows")
    counted = F.coalesce(F.nullif(F.countDistinct(F.when(F.col("way") < RUNS, F.col("at"))), F.lit(0)), F.countDistinct("at"))
    sizes = items.groupBy(F.col("item").alias("whose")).agg(counted.alias("item_windows"))
    item = items.select("item", "w1", "w2", F.col("at").alias("item_at"), F.col("slots").alias("item_slots"), "words", "n_items", F.col("way").alias("item_way"))
    item = item.join(sizes, F.col("item").eqNullSafe(F.col("whose"))).drop("whose")
    hits = found.select(F.col("id").alias("doc"), "w1", "w2", "at", "slots", "way").join(item, ["w1", "w2"])
    # a window of the document and one of the item match once, in the first way that they do
    hits = hits.groupBy("doc", "item", "at", "item_at").agg(
        F.min(F.struct("item_way", "way", "slots", "item_slots", "words", "item_windows", "n_items")).alias("m")).select(
        "doc", "item", "at", "item_at", *[F.col(f"m.{c}") for c in ("slots", "item_slots", "words", "item_windows", "n_items")])

    # the whole document (grid 0), single shifts, and stretches of shifts in two grids; no join, so that nulls and hot documents are as others
    shift = F.col("at") - F.col("item_at")
    places = [F.lit(0), shift, F.floor(shift / F.col("words")), F.floor((shift + F.floor(F.col("words") / 2)) / F.col("words"))]
    occurrence = F.explode(F.array(*[F.struct(F.lit(i).alias("grid"), p.cast("bigint").alias("place")) for i, p in enumerate(places)]))
    pairs = F.transform(F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), lambda x: F.struct(F.lit(True).alias("slot"), x["a"].alias("a"), x["b"].alias("b")))
    windows_ = F.array(F.struct(F.lit(False).alias("slot"), F.col("item_at").cast("bigint").alias("a"), F.lit(0).cast("bigint").alias("b")))
    both = F.struct("item_windows", "n_items").alias("sizes")
    facts = hits.select("doc", "item", both, F.explode(F.concat(windows_, pairs)).alias("x"), *[F.col(c) for c in ("at", "item_at", "words")])
    facts = facts.select("doc", "item", "sizes", "x", occurrence.alias("place"))
    values = facts.groupBy("doc", "item", "place", F.col("x.slot").alias("slot"), F.col("x.a").alias("a")).agg(
        (F.min("x.b") == F.max("x.b")).alias("one"), F.max("sizes").alias("sizes"))
    checked = values.groupBy("doc", "item", "place").agg(
        F.max("sizes.item_windows").alias("item_windows"), F.max("sizes.n_items").alias("n_items"),
        F.least(F.count(F.when(~F.col("slot"), 1)), F.max("sizes.item_windows")).alias("windows"), F.count(F.when(F.col("slot"), 1)).alias("slots"),
        F.coalesce(F.avg(F.when(F.col("slot"), F.col("one").cast("double"))), F.lit(1.0)).alias("slot_share"))
    checked = checked.withColumn("slot_share", F.round("slot_share", 6)).filter((F.col("windows") >= share * F.col("item_windows")) & (F.col("slot_share") >= share))
    # the figures of the whole document where it passes, else those of its best occurrence
    best = F.max(F.struct((F.col("place.grid") == 0).alias("whole"), "slot_share", "windows", "slots", "item_windows", "n_items")).alias("best")
    return checked.groupBy("doc", "item").agg(best).select("doc", "item", *[f"best.{c}" for c in ("windows", "item_windows", "slots", "slot_share", "n_items")])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE, links: bool = False) -> DataFrame:
    """One row per document and class of benchmark items that it holds: ``doc_id, item_id`` (of the class's smallest item), ``windows`` (matched),
    ``item_windows``, ``slots`` (matched slot values of the item) and ``slot_share`` (of them consistent); with ``links``
    also ``n_items``, the items of the class."""
    out = _contaminated(docs, benchmark, window, literals, share)
    return out.select(F.col("doc.id").alias("doc_id"), F.col("item.id").alias("item_id"), "windows", "item_windows", "slots", "slot_share",
                      *(["n_items"] if links else []))


def _lengths(batches):
    """The words of each item."""
    pw = Powers()
    for part in slices(batches, "text"):
        data, offs, _ = flat_bytes(part.column(1))
        count = np.diff(canonical(data, offs, pw)[-1]).astype(np.int32)
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count)], names=["own", "words"])


def clean_documents(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literals: int = LITERALS, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` (all columns) that hold no benchmark item."""
    key = "key_text"
    while key in docs.columns:
        key += "_"
    bad = _contaminated(docs, benchmark, window, literals, share).select(F.col("doc.id").alias("gone_doc_id"), F.col("doc.text").alias(f"gone_{key}"))
    return without(docs.withColumn(key, F.xxhash64("text")), bad, "contaminated").drop(key)
