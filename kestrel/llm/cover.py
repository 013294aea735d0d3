"""Hard negatives by inner product, searched in cover trees over norm-augmented vectors.

Components are quantised to integers (``floor(256 x)``), so that scores are exact.  A block of about ``BLOCK`` rows gets one
tree for each of its labels.  Every vector x gets one more component, ``sqrt(M^2 - |x|^2)`` with the block's largest
norm M, so that all lie on one sphere and, for an anchor q, ``q.x = (|q|^2 + M^2 - d^2) / 2``: a node's centre and covering
radius bound the inner products below it on both sides.  Levels of a tree shrink by ``BASE``; a level's centres are more
than its scale apart and every point lies within the scale of its centre.

The anchors, a stated share of the rows, go over all blocks in groups of bounded size: a group is broadcast, every task
descends its trees level by level, leaves nodes whose bounds miss the anchor's window, visits the remaining leaves best
first while they can still reach the k-th score found in the task so far, and verifies each leaf by exact products.  Tasks
hand on k rows of each window at most; these are ranked again.

Defined results: rows with a null label, a null vector or a component that is null or not finite take no part; shorter
vectors end in zeros; quantised components stop at the size that keeps inner products below 2**53 (some 46,000 in x for 64
components), beyond which they saturate; a null id is no anchor, comes after all others among equal scores and counts as
not divisible; repeated rows are rows: a copy of an anchor is another row, and an anchor that stands n times has its
results n times; a negative positive score has an empty window; an empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.shared import ship, shipped, written

BLOCK = 2048  # rows of a block, about
LEAF = 32
BASE = 1.3
GROUP = 8192  # anchors of a pass, about
SCALE = 256
ANCHOR_EVERY, RELABEL_EVERY, CLASSES = 100, 7, 10
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # the window, in hundredths of the positive's score
NO_ID = (1 << 63) - 1


# ------------------------------------------------------------------ trees
def tree(points: np.ndarray, leaf: int = LEAF, base: float = BASE):
    """A cover tree of augmented ``points``: the order of its points, and nodes (parent, centre, radius, start, end, is leaf)
    level by level; a node covers the points ``order[start:end]``."""
    far = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    scale = float(far.max(initial=0.0))
    order = np.arange(len(points))
    nodes, level = [], [(-1, 0, 0, len(points), far)]
    while level:
        scale /= base
        below = []
        for parent, centre, start, end, dist in level:
            radius = float(dist.max(initial=0.0))
            small = end - start <= leaf or radius == 0
            if radius <= scale and not small:  # the same node stands at the next level too
                below.append((parent, centre, start, end, dist))
                continue
            at = len(nodes)
            nodes.append((parent, centre, radius, start, end, small))
            if small:
                continue
            own = points[order[start:end]]
            centres, dists = [centre], [dist]
            nearest = dist.copy()
            while nearest.max() > scale:  # the farthest point becomes a centre: it is more than the scale away from the others
                c = int(nearest.argmax())
                d = np.sqrt(((own - own[c]) ** 2).sum(axis=1))
                centres.append(int(order[start + c]))
                dists.append(d)
                nearest = np.minimum(nearest, d)
            choice = np.argmin(np.stack(dists), axis=0)
            place = np.argsort(choice, kind="stable")
            order[start:end] = order[start:end][place]
            for k, (c, d) in enumerate(zip(centres, dists)):
                held = choice == k
                size = int(held.sum())
                if size:
                    below.append((at, c, start, start + size, d[held]))
                    start += size
        level = below
    return order, nodes


class Block:
    """The trees of one block's rows, as arrays."""

    FIELDS = {"ids": np.int64, "copies": np.int64, "vectors": np.int32, "parent": np.int32, "centre": np.int32, "radius": np.float64, "start": np.int32, "end": np.int32, "leaf": np.bool_, "kind": np.int64}

    def __init__(self, dim: int, arrays: dict):
        self.dim = dim
        for k, v in arrays.items():
            setattr(self, k, v)
        self.vectors = self.vectors.reshape(len(self.ids), -1)
        self.floats = self.vectors.astype(np.float64)
        self.top = float((self.floats ** 2).sum(axis=1).max(initial=0.0))

    @staticmethod
    def build(ids, labels, copies, vectors, leaf: int = LEAF) -> dict:
        """Arrays of the trees, one for each label; rows are put into the order of the leaves."""
        floats = vectors.astype(np.float64)
        square = (floats ** 2).sum(axis=1)
        points = np.concatenate([floats, np.sqrt(square.max(initial=0.0) - square)[:, None]], axis=1)
        rows, nodes, kinds = [], [], []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            order, found = tree(points[own], leaf)
            done, first = sum(map(len, rows)), len(nodes)
            back = np.empty(len(own), np.int64)
            back[order] = np.arange(len(own))
            rows.append(own[order])
            nodes += [(p + first if p >= 0 else -1, done + back[c], r, done + s, done + e, small) for p, c, r, s, e, small in found]
            kinds += [label] * len(found)
        rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        columns = list(zip(*nodes)) if nodes else [[]] * 6
        out = {"ids": ids[rows], "copies": copies[rows], "vectors": vectors[rows].ravel(), "kind": kinds}
        out |= dict(zip(("parent", "centre", "radius", "start", "end", "leaf"), columns))
        return {k: np.asarray(out[k], dtype).tobytes() for k, dtype in Block.FIELDS.items()}

    def search(self, found: Found, same: bool) -> None:
        """Bring ``found`` up to date with this block; ``same``: rows of the query's label, else of all others."""
        for at in range(0, len(found.vectors), 1024):
            self._search(found, np.arange(at, min(at + 1024, len(found.vectors))), same)

    def _search(self, found, queries, same):
        q = found.vectors[queries]
        square = (q ** 2).sum(axis=1)[:, None]
        dot = q @ self.floats[self.centre].T
        dist = np.sqrt(np.maximum(square + self.top - 2 * dot, 0))  # between augmented vectors
        slack = 1e-9 * (square + self.top) + 1e-3
        upper = (square + self.top - np.maximum(dist - self.radius, 0) ** 2) / 2 + slack
        lower = (square + self.top - (dist + self.radius) ** 2) / 2 - slack
        alive = (found.labels[queries][:, None] == self.kind) == same
        alive &= (upper >= np.maximum(found.scores[queries, -1], found.low[queries])[:, None]) & (lower <= found.high[queries][:, None])
        for k in np.flatnonzero(self.parent >= 0):  # nodes stand after their parents
            alive[:, k] &= alive[:, self.parent[k]]
        leaves = np.flatnonzero(self.leaf)
        bound = np.where(alive[:, leaves], np.minimum(upper[:, leaves], found.high[queries][:, None]), -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        for at in range(0, len(leaves), 4):  # the best leaves first, four at a time
            some = order[:, at:at + 4]
            reach = np.take_along_axis(bound, some, axis=1)
            go = (reach > -np.inf) & (reach >= found.scores[queries, -1][:, None])
            if not go.any():
                break
            row, col = np.nonzero(go)
            leaf = some[row, col]
            place = np.argsort(leaf, kind="stable")
            row, leaf = row[place], leaf[place]
            for first, last in zip(*_groups(leaf)):
                node = leaves[leaf[first]]
                self._verify(found, queries[row[first:last]], int(self.start[node]), int(self.end[node]))

    def _verify(self, found, queries, start, end):
        scores = found.vectors[queries] @ self.floats[start:end].T
        fits = (scores >= np.maximum(found.low[queries], found.scores[queries, -1])[:, None]) & (scores <= found.high[queries][:, None])
        some = fits.any(axis=1)
        if some.any():
            found.add(queries[some], np.where(fits[some], scores[some], -np.inf), self.ids[start:end], self.copies[start:end])


def _groups(sorted_values):
    cuts = np.flatnonzero(np.diff(sorted_values)) + 1
    return np.concatenate(([0], cuts)), np.concatenate((cuts, [len(sorted_values)]))


class Found:
    """Queries (vector, label, window) and the k best rows of each so far: score descending, then id."""

    def __init__(self, vectors, labels, low, high, k: int):
        n = len(vectors)
        self.vectors, self.labels, self.low, self.high = vectors, labels, low, high
        self.scores, self.ids, self.copies = np.full((n, k), -np.inf), np.full((n, k), NO_ID), np.zeros((n, k), np.int64)

    def add(self, queries, scores, ids, copies):
        k = self.scores.shape[1]
        wide = np.broadcast_to
        s = np.concatenate([self.scores[queries], scores], axis=1)
        i = np.concatenate([self.ids[queries], wide(ids, scores.shape)], axis=1)
        c = np.concatenate([self.copies[queries], wide(copies, scores.shape)], axis=1)
        best = np.lexsort((i, -s), axis=1)[:, :k]
        self.scores[queries], self.ids[queries], self.copies[queries] = (np.take_along_axis(a, best, axis=1) for a in (s, i, c))


# ------------------------------------------------------------------ Spark
def quantised(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """Distinct ``vec_id, label, vector`` rows with their number of ``copies``, and the vectors' length."""
    rows = embeddings.select(*[F.col(f"`{c}`") for c in ("vec_id", "label", "embedding")])
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = rows.filter(F.col("label").isNotNull() & F.col("embedding").isNotNull()).filter(sound)
    dim = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    most = int((2 ** 53 / max(dim, 1)) ** 0.5)
    label = F.col("label").cast("bigint")
    label = F.when(F.coalesce(F.col("vec_id") % RELABEL_EVERY == 0, F.lit(False)), (label + 1) % CLASSES).otherwise(label)
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-most), F.least(F.lit(most), F.floor(SCALE * x.cast("double")))).cast("int"))
    return rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), label.alias("label"), whole.alias("vector")).groupBy("vec_id", "label", "vector").agg(F.count("*").alias("copies")), int(dim)


def matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix; shorter rows end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(size), dim), np.int32)
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten())
    return out


def index(rows: DataFrame, dim: int, block: int = BLOCK, leaf: int = LEAF) -> DataFrame:
    """Every row in a tree: one packed row for each block, written to the shared folder."""
    blocks = max(1, -(-rows.count() // block))
    tasks = min(blocks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(blocks))).repartition(tasks, "block")

    def pack(group: pa.Table) -> pa.Table:
        ids = np.asarray(group["vec_id"].fill_null(NO_ID))
        packed = Block.build(ids, np.asarray(group["label"]), np.asarray(group["copies"]), matrix(group["vector"], dim), leaf)
        return pa.table({k: pa.array([packed[k]], pa.binary()) for k in Block.FIELDS})

    return written(dealt.groupBy("block").applyInArrow(pack, ", ".join(f"{k} binary" for k in Block.FIELDS)), "cover-trees")


FOUND = pa.schema([("query", pa.int64()), ("found_id", pa.int64()), ("score", pa.int64()), ("copies", pa.int64())])


def _descend(batches, broadcast, dim, k, same):
    found = Found(*shipped(broadcast), k)
    for batch in batches:
        for i in range(batch.num_rows):
            held = batch.slice(i, 1).to_pydict()
            Block(dim, {name: np.frombuffer(held[name][0], kind) for name, kind in Block.FIELDS.items()}).search(found, same)
    row, col = np.nonzero(found.scores > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(found.ids[row, col]), pa.array(found.scores[row, col].astype(np.int64)), pa.array(found.copies[row, col])], schema=FOUND)


def search(trees: DataFrame, vectors, labels, low, high, k: int, dim: int, same: bool) -> DataFrame:
    """``query, rank, found_id, score``: the k best rows of each query's window; copies of a row are rows."""
    broadcast = ship(trees.sparkSession, (vectors, labels, low, high))
    part = trees.mapInArrow(lambda it: _descend(it, broadcast, dim, k, same), "query bigint, found_id bigint, score bigint, copies bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "found_id")
    part = part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    part = part.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)).cast("int"))))
    return part.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "found_id", "score")


def _mined(trees: DataFrame, anchors: DataFrame, dim: int) -> DataFrame:
    """Positives and negatives of one group of anchors."""
    spark = trees.sparkSession
    rows = anchors.toArrow()
    vectors = matrix(rows["vector"], dim).astype(np.float64)
    ids, labels, copies = (np.asarray(rows[c]) for c in ("vec_id", "label", "copies"))
    n = len(ids)
    own = (vectors ** 2).sum(axis=1).astype(np.int64)
    table = spark.createDataFrame(list(zip(range(n), ids.tolist(), own.tolist(), copies.tolist())), "query bigint, anchor_id bigint, own bigint, anchors bigint")
    # one more than asked for, as an anchor may find itself: one row of its id and score is the anchor
    near = search(trees, vectors, labels, np.full(n, -np.inf), np.full(n, np.inf), POSITIVES + 1, dim, True).join(F.broadcast(table), "query")
    itself = (F.col("found_id") == F.col("anchor_id")) & (F.col("score") == F.col("own"))
    near = near.withColumn("itself", itself).withColumn("nth", F.row_number().over(Window.partitionBy("query", "itself").orderBy("rank"))).filter(~(F.col("itself") & (F.col("nth") == 1)))
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("place") <= POSITIVES)
    near = written(near.select("query", "anchor_id", "anchors", "place", F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # (query, score) pairs of the group: POSITIVES for each anchor at most
    windows = near.filter("positive_score >= 0").select("query", "positive_score").distinct().orderBy("query", "positive_score").toArrow()
    of, score = (np.asarray(windows[c]) for c in ("query", "positive_score"))
    low, high = -(-LOW * score // 100), HIGH * score // 100
    found = search(trees, vectors[of], labels[of], low.astype(np.float64), high.astype(np.float64), NEGATIVES, dim, False)
    pairs = spark.createDataFrame(list(zip(range(len(of)), of.tolist(), score.tolist())), "query bigint, of bigint, at bigint")
    found = found.join(F.broadcast(pairs), "query").drop("query")
    out = near.join(found, (F.col("query") == F.col("of")) & (F.col("positive_score") == F.col("at")))
    null = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return written(out.withColumn("again", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("anchors")))).select(
        "anchor_id", null("positive_id").alias("positive_id"), "rank", null("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives")


SCHEMA = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def hard_negatives(embeddings: DataFrame, block: int = BLOCK, leaf: int = LEAF, group: int = GROUP) -> DataFrame:
    """The negatives of every anchor and positive."""
    rows, dim = quantised(embeddings)
    rows = written(rows, "vectors")
    trees = index(rows, dim, block, leaf)
    anchors = rows.filter(F.col("vec_id") % ANCHOR_EVERY == 0)
    groups = -(-anchors.count() // group)
    out = rows.sparkSession.createDataFrame([], SCHEMA)
    for g in range(groups):
        out = out.unionByName(_mined(trees, anchors.filter(F.pmod(F.xxhash64("vector", "vec_id", "label"), F.lit(groups)) == g), dim))
    return out


def hard_negatives_sql() -> str:
    """The same in DuckDB SQL, by brute force."""
    return f"""WITH e AS (SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % {RELABEL_EVERY} = 0 THEN (label + 1) % {CLASSES} ELSE label END AS label,
  list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (SELECT a.rid, a.vec_id AS anchor_id, c.rid AS other, c.vec_id AS found_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM e a JOIN e c ON c.rid <> a.rid WHERE a.vec_id % {ANCHOR_EVERY} = 0),
pos AS (SELECT rid, anchor_id, other, found_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, found_id) <= {POSITIVES})
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.found_id) AS INTEGER) AS rank,
  n.found_id AS negative_id, p.positive_score, n.score AS negative_score
FROM pos p JOIN pairs n ON n.rid = p.rid AND NOT n.same AND {LOW} * p.positive_score <= 100 * n.score AND 100 * n.score <= {HIGH} * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.found_id) <= {NEGATIVES}"""
