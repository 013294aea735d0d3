"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text becomes a sparse vector: its words (ASCII case folded) hashed to ``WORDS`` places with damped counts, brought to
unit length; its structure statistics and its metadata (``n_chars`` and how far it is from the text's length), each as one
of at most ``BINS`` places by the quantiles of the learning rows.  The score is

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2),

the pairwise interactions of rank ``RANK`` in time linear in the row's words (sum-of-squares identity).  The machine is
fitted on a bounded sample: at most ``sample`` labelled rows of each class, smallest id hash first; class shares of all
labelled rows set the intercept back to the whole.  Scoring is one pass over whole texts, nothing is shuffled.

Defined results: a null text is an empty one and is scored by its statistics, a null ``n_chars`` is a place of its own;
labels of rows that repeat count once for each id and value, a null label is no label; without labelled rows of both
classes the score is the share of label 1 (0.5 if there is no label at all); a null id counts as the empty text in the
split; repeated rows give repeated results; an empty table gives no rows; other columns are ignored, whatever their
names.  A very long text is a slice of its own: memory follows it, at some hundred bytes a word.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.llm.shared import plain, ship, shipped
from kestrel.llm.text import Powers, flat_bytes, mix, slices, span_hash, prefix, word_hashes, word_spans

SAMPLE = 4096  # labelled rows of each class that the machine learns from
WORDS = 1 << 16
BINS = 16
RANK = 8
EPOCHS = 12
BATCH = 128
RATE = 0.05
SHRINK = 1e-4
WEIGHT = 0.35  # of a statistic's place, beside the words' unit length
THRESHOLD = 0.3

# places of one byte in a table of kinds
UPPER, LOWER, DIGIT, SYMBOL, STOP, OTHER, WIDE = range(7)
STATISTICS = ("words", "bytes_a_word", "upper", "digits", "symbols", "stops", "others", "wide", "distinct_words", "top_word", "distinct_triples",
              "lines", "words_a_line", "repeated_lines", "plain_words", "n_chars", "n_chars_off")


def kinds() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[128:] = WIDE
    for chars, kind in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), ("abcdefghijklmnopqrstuvwxyz", LOWER), ("0123456789", DIGIT), ("#*$%&|<>@^~=+_", SYMBOL), (".,;:?!", STOP)):
        out[np.frombuffer(chars.encode(), np.uint8)] = kind
    return out


def fold() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


class Reader:
    """Rows of (text, n_chars) to sparse word vectors and statistics, a slice at a time."""

    def __init__(self):
        self.kinds, self.fold, self.powers = kinds(), fold(), Powers()

    def read(self, texts: pa.Array, n_chars: pa.Array):
        """(row of each entry, place, value) of the words, sorted by row and place, and the rows' statistics."""
        data, offs, _ = flat_bytes(texts)
        n = len(offs) - 1
        low = self.fold[data]
        starts, ends, first = word_spans(low, offs)
        owner = np.repeat(np.arange(n), np.diff(first))
        hashes = word_hashes(low, starts, ends, self.powers) if len(starts) else np.zeros(0, np.uint64)
        n_words = np.diff(first).astype(float)
        place = (hashes >> np.uint64(40)).astype(np.int64) % WORDS
        key, count = np.unique(owner * WORDS + place, return_counts=True)
        row, place = key // WORDS, key % WORDS
        value = 1 + np.log(count)
        length = np.sqrt(np.bincount(row, weights=value * value, minlength=n))
        value /= length[row]
        per = lambda a: a / np.maximum(n_words, 1)
        kind = self.kinds[data]
        size = np.maximum(np.diff(offs), 1).astype(float)

        def share(k):
            run = np.concatenate(([0], np.cumsum(kind == k)))
            return (run[offs[1:]] - run[offs[:-1]]) / size

        top = np.zeros(n)
        np.maximum.at(top, row, count)
        lines, repeated = self.lines(low, offs)
        clean = np.concatenate(([0], np.cumsum((kind == SYMBOL) | (kind == DIGIT) | (data == 33))))
        plain_words = np.bincount(owner, weights=(clean[ends] - clean[starts]) == 0, minlength=n)
        told = np.asarray(n_chars.cast(pa.float64()).fill_null(-1.0))
        code_points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        chars = code_points[offs[1:]] - code_points[offs[:-1]]
        stats = np.stack([np.log1p(n_words), per(np.bincount(owner, weights=ends - starts, minlength=n)), share(UPPER), share(DIGIT), share(SYMBOL), share(STOP), share(OTHER), share(WIDE),
                          per(np.bincount(row, minlength=n)), per(top), self.triples(hashes, owner, first, n), np.log1p(lines), n_words / np.maximum(lines, 1), repeated, per(plain_words),
                          np.where(told < 0, -1.0, np.log1p(np.maximum(told, 0))), np.where(told < 0, -1.0, np.log1p(np.abs(told - chars)))], axis=1)
        return row, place, value, stats

    def triples(self, hashes, owner, first, n):
        """Share of different runs of three words."""
        at = np.arange(max(len(hashes) - 2, 0))
        at = at[owner[at] == owner[at + 2]] if len(at) else at
        runs = mix(hashes[at] + mix(hashes[at + 1] + mix(hashes[at + 2])))
        order = np.lexsort((runs, owner[at]))
        runs, own = runs[order], owner[at][order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (own[1:] != own[:-1])
        return np.bincount(own, weights=new, minlength=n) / np.maximum(np.diff(first) - 2, 1)

    def lines(self, low, offs):
        """Lines with a byte, and the share of them that repeat an earlier one."""
        n = len(offs) - 1
        cut = np.unique(np.concatenate((offs, np.flatnonzero(low == 10), np.flatnonzero(low == 10) + 1)))
        starts, ends = cut[:-1], cut[1:]
        held = low[starts] != 10 if len(starts) else np.zeros(0, bool)
        starts, ends = starts[held], ends[held]
        if not len(starts):
            return np.zeros(n), np.zeros(n)
        owner = np.searchsorted(offs, starts, side="right") - 1
        hashes = span_hash(prefix(low.astype(np.uint64) + np.uint64(1), self.powers), starts, ends, self.powers)
        order = np.lexsort((hashes, owner))
        h, own = hashes[order], owner[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
        total = np.bincount(own, minlength=n).astype(float)
        return total, np.bincount(own, weights=again, minlength=n) / np.maximum(total, 1)


class Machine:
    """Edges of the statistics' bins and the weights; ``weights`` has the linear weight in its last column."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray | None, bias: float):
        self.edges, self.weights, self.bias, self.kept = edges, weights, bias, None

    def reader(self) -> Reader:
        if self.kept is None:
            self.kept = Reader()
        return self.kept

    def places(self, stats: np.ndarray) -> np.ndarray:
        return WORDS + np.stack([k * BINS + np.searchsorted(e, stats[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)

    def rows(self, row, place, value, stats):
        """The sparse rows of words and statistics: offsets, places, values."""
        n = len(stats)
        words = np.bincount(row, minlength=n)
        extra = self.places(stats)
        offs = np.concatenate(([0], np.cumsum(words + extra.shape[1])))
        at = np.arange(len(row)) + row * extra.shape[1]
        places, values = np.empty(offs[-1], np.int64), np.full(offs[-1], WEIGHT)
        rest = np.ones(offs[-1], bool)
        rest[at] = False
        places[at], values[at], places[rest] = place, value, extra.ravel()
        return offs, places, values

    def raw(self, offs, places, values) -> np.ndarray:
        """The machine's value of each row, by the sum-of-squares identity."""
        terms = self.weights[places] * values[:, None]
        sums = np.add.reduceat(terms, offs[:-1], axis=0)
        squares = np.add.reduceat(terms[:, :-1] ** 2, offs[:-1], axis=0)
        return self.bias + sums[:, -1] + 0.5 * (sums[:, :-1] ** 2 - squares).sum(axis=1)

    def score(self, texts: pa.Array, n_chars: pa.Array) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), 1 / (1 + np.exp(-self.bias)))
        return 1 / (1 + np.exp(-np.clip(self.raw(*self.rows(*self.reader().read(texts, n_chars))), -50, 50)))


def train(offs, places, values, labels, edges, rank=RANK, epochs=EPOCHS, seed=1) -> Machine:
    """Logistic loss by stochastic gradients with a step size of each weight's own (sum of its squared gradients)."""
    random = np.random.default_rng(seed)
    size = WORDS + len(edges) * BINS
    weights = np.concatenate([random.normal(0, 0.05, (size, rank)), np.zeros((size, 1))], axis=1)
    spread, bias, bias_spread = np.full((size, rank + 1), 1e-4), 0.0, 1e-4
    machine = Machine(edges, weights, bias)
    length = np.diff(offs)
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for at in range(0, len(order), BATCH):
            rows = order[at:at + BATCH]
            size_ = length[rows]
            own = np.concatenate(([0], np.cumsum(size_)))
            take = np.repeat(offs[rows] - own[:-1], size_) + np.arange(own[-1])
            p, x = places[take], values[take]
            machine.bias = bias
            error = 1 / (1 + np.exp(-np.clip(machine.raw(own, p, x), -50, 50))) - labels[rows]
            g = np.repeat(error, size_) * x
            terms = weights[p] * x[:, None]
            sums = np.repeat(np.add.reduceat(terms, own[:-1], axis=0)[:, :-1], size_, axis=0)
            grads = np.concatenate([g[:, None] * (sums - terms[:, :-1]), g[:, None]], axis=1)
            used, back = np.unique(p, return_inverse=True)
            sort = np.argsort(back, kind="stable")
            step = np.add.reduceat(grads[sort], np.searchsorted(back[sort], np.arange(len(used))), axis=0) / len(rows) + SHRINK * weights[used]
            spread[used] += step * step
            weights[used] -= RATE * step / np.sqrt(spread[used])
            b = error.mean()
            bias_spread += b * b
            bias -= RATE * b / np.sqrt(bias_spread)
    machine.bias = bias
    return machine


# ------------------------------------------------------------------ Spark
def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text divisible by five: never learned from."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


SPARSE = "row_hash bigint, place array<int>, value array<float>, stats array<double>"


def _sparse(batches):
    reader = Reader()
    for part in slices(batches, "text"):
        row, place, value, stats = reader.read(part.column(1), part.column(2))
        offs = pa.array(np.searchsorted(row, np.arange(len(stats) + 1)), pa.int32())
        wide = pa.array(np.arange(len(stats) + 1) * stats.shape[1], pa.int32())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offs, pa.array(place, pa.int32())), pa.ListArray.from_arrays(offs, pa.array(value, pa.float32())),
                                          pa.ListArray.from_arrays(wide, pa.array(stats.ravel()))], names=["row_hash", "place", "value", "stats"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, **how) -> Machine:
    """Learn from ``doc_id, quality`` of ``labels`` and ``doc_id, text, n_chars`` of ``docs``; held-out rows are left out.

    At most ``sample`` ids of each class are chosen from the labels (a broadcast of bounded size), and of the rows of
    these ids at most ``sample`` again; only their sparse vectors reach the driver.
    """
    known = labels.select("doc_id", (F.col("quality") >= 1).cast("int").alias("y")).filter(
        F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).distinct()
    shares = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if len(shares) < 2:
        total = sum(shares.values())
        return Machine([], None, float(np.log((shares.get(1, 0) + 0.5) / (shares.get(0, 0) + 0.5))) if total else 0.0)
    rows, truth = [], []
    for y in sorted(shares):
        chosen = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("chosen_id"))
        own = plain(docs, "doc_id", "text", "n_chars").join(F.broadcast(chosen), F.col("doc_id") == F.col("chosen_id"), "left_semi")
        own = own.select(F.xxhash64("doc_id", "text", "n_chars").alias("row_hash"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("double").alias("n_chars"))
        got = own.mapInArrow(_sparse, SPARSE).orderBy("row_hash").limit(sample).collect()
        rows += got
        truth += [y] * len(got)
    labels_ = np.array(truth, float)
    if len(set(truth)) < 2:
        return Machine([], None, float(np.log((shares[1] + 0.5) / (shares[0] + 0.5))))
    stats = np.array([r["stats"] for r in rows])
    edges = [np.unique(np.quantile(stats[:, k], np.arange(1, BINS) / BINS)) for k in range(stats.shape[1])]
    owner = np.repeat(np.arange(len(rows)), [len(r["place"]) for r in rows])
    flat = Machine(edges, None, 0.0).rows(owner, np.array([p for r in rows for p in r["place"]], np.int64), np.array([v for r in rows for v in r["value"]], float), stats)
    machine = train(*flat, labels_, edges, **how)
    machine.weights = machine.weights.astype(np.float32)
    machine.bias += float(np.log(shares[1] / shares[0]) - np.log(labels_.sum() / (len(labels_) - labels_.sum())))
    return machine


def _scored(batches, broadcast):
    machine = shipped(broadcast)
    for part in slices(batches, "text"):
        score = machine.score(part.column(part.schema.get_field_index("text")), part.column(part.schema.get_field_index("n_chars")))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(score, pa.float64())], names=["doc_id", "held_out", "score"])


def classify(docs: DataFrame, machine: Machine, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row."""
    broadcast = ship(docs.sparkSession, machine)
    rows = plain(docs, "doc_id", "text", "n_chars").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"), F.col("n_chars").cast("double").alias("n_chars"))
    out = rows.mapInArrow(lambda it: _scored(it, broadcast), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Learn from the labelled rows that are not held out and score all."""
    return classify(docs, fit(docs, labels, **how))
