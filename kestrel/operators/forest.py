"""M3, M4 over all rows: random forests whose trees are grown by tasks, and their grid search.

Rows are binned once (31 thresholds for a feature at most, from all rows) and packed to blocks of bytes.  A task takes
some trees of one fold and grows them level by level in numpy; what a level needs is counts by node, feature, bin and class.

* A tree is known by its number: its bootstrap is a hash of (seed, tree, row key), the features of a node one of (seed,
  tree, node).  So the first 100 trees of 200 are the forest of 100, and a tree stopped at depth 6 is the top of the one
  that goes on.  The grid search grows the deepest, largest forest of each fold and takes every grid point's scores
  from it: they are what that grid point's forest gives when it is grown alone.
* Trees of the search are never kept: a task returns the sums of their probabilities for the rows of its fold.
* The refit writes a node table in Spark ML's own model format, so the model is a ``RandomForestClassificationModel``.

A task holds the binned rows (about 50 bytes a row with its working arrays), the driver thresholds and one number for
each fold and grid point.
"""
from __future__ import annotations

import json
import time
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.operators import prep as P
from kestrel.session import new_folder, stored

BINS = 32
#: Thresholds of a column are values at ranks that are exact up to this many rows, and off by n / SKETCH rows at most.
SKETCH = 100_000
#: Nodes of a level that are worked on together; a level of more than four times as many is dealt into parts.
NODES = 1024
STEP = 1 << 18  # rows that are worked on at a time, so that what is computed from them stays small
GROUPS = 4  # groups of trees for each core
POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 17)]))


def mixed(v: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser on unsigned 64-bit numbers."""
    v = (v ^ (v >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    v = (v ^ (v >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return v ^ (v >> np.uint64(31))


def _salt(seed: int, tree: int, step: int) -> np.ndarray:
    return mixed(np.array([seed * 1_000_003 + tree * 8 + step + 1], np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def bootstrap(keys: np.ndarray, seed: int, tree: int) -> np.ndarray:
    """How often each row (by its 64-bit key) is drawn for a tree: Poisson with mean 1."""
    out, salt = np.empty(len(keys), np.uint8), _salt(seed, tree, 0)
    for i in range(0, len(keys), STEP):
        u = (mixed(keys[i:i + STEP].view(np.uint64) ^ salt) >> np.uint64(11)).astype(np.float64) / 2.0**53
        out[i:i + STEP] = np.searchsorted(POISSON, u, side="right")
    return out


def node_features(heap: np.ndarray, n_features: int, subset: int, seed: int, tree: int) -> np.ndarray:
    """The ``subset`` features, ascending, that each node (by heap number) may be split by."""
    at = heap.astype(np.uint64)[:, None] * np.uint64(n_features) + np.arange(n_features, dtype=np.uint64)
    order = np.argpartition(mixed(mixed(at) ^ _salt(seed, tree, 1)), min(subset, n_features - 1), axis=1)[:, :subset]
    return np.sort(order, axis=1)


def _splits(x, at, node, y, c, feats, n0, n1, w):
    """Best feature, bin and the counts left of it for each node, and the weighted Gini sum of the two sides (inf: no split)."""
    m, width = len(n0), x.shape[1]
    flat, best = x.reshape(-1), np.full(m, np.inf)
    feature, cut, left0, left1 = (np.zeros(m, t) for t in (np.int64, np.int64, np.float64, np.float64))
    for k in range(feats.shape[1]):
        f, counts = feats[:, k], np.zeros(m * BINS * 2)
        for i in range(0, len(at), STEP):
            rows, of = at[i:i + STEP].astype(np.int64), node[i:i + STEP].astype(np.int64)
            counts += np.bincount((of * BINS + flat[rows * width + f[of]]) * 2 + y[rows], c[rows], m * BINS * 2)
        below = np.cumsum(counts.reshape(m, BINS, 2), axis=1)[:, :-1]
        a0, a1 = below[:, :, 0], below[:, :, 1]
        l0, l1, r0, r1 = a0 * w[0], a1 * w[1], (n0[:, None] - a0) * w[0], (n1[:, None] - a1) * w[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            side = l0 * l1 / (l0 + l1) + r0 * r1 / (r0 + r1)  # nan where a side is empty
        side = np.where(np.isnan(side), np.inf, side)
        b = side.argmin(axis=1)
        row = np.arange(m)
        better = side[row, b] < best
        best = np.where(better, side[row, b], best)
        feature, cut = np.where(better, f, feature), np.where(better, b, cut)
        left0, left1 = np.where(better, a0[row, b], left0), np.where(better, a1[row, b], left1)
    return best, feature, cut, left0, left1


def _below(x, at, node, feature, cut):
    """The numbers of the nodes below a split that rows go to: twice its own, and one more above the bin."""
    out, flat = np.empty(len(at), np.int32), x.reshape(-1)
    for i in range(0, len(at), STEP):
        of = node[i:i + STEP]
        out[i:i + STEP] = 2 * of + (flat[at[i:i + STEP].astype(np.int64) * x.shape[1] + feature[of]] > cut[of])
    return out


def grow(x: np.ndarray, y: np.ndarray, c: np.ndarray, asked: np.ndarray, depths: Sequence[int], w, subset: int, seed: int, tree: int, keep: bool = False):
    """One tree over the binned rows ``x`` (n x features), classes ``y``, drawn ``c`` times each (0: not at all).

    Returns the probability of class 1 of the rows numbered ``asked`` when the tree ends at each of ``depths`` (ascending),
    and with ``keep`` its nodes (heap number, feature or -1, bin, counts of both classes, gain) in heap order.
    """
    drawn = np.flatnonzero(c)
    out, nodes = np.zeros((len(depths), len(asked))), []
    total = np.array([c[y == k].sum(dtype=np.float64) for k in (0, 1)])
    zero = lambda n: np.zeros(n, np.int32)
    todo = [(0, np.ones(1, np.int64), total[:1], total[1:], drawn.astype(np.int32), zero(len(drawn)), np.arange(len(asked), dtype=np.int32), zero(len(asked)))]
    while todo:
        depth, heap, n0, n1, at, node, who, where = todo.pop()
        mass = n0 * w[0] + n1 * w[1]
        p = np.divide(n1 * w[1], mass, out=np.zeros(len(mass)), where=mass > 0)
        rest = [i for i, d in enumerate(depths) if d >= depth]
        out[np.ix_(rest, who)] = p[where]  # the deeper ones are written again below a split
        split = np.zeros(len(heap), bool)
        if depth < depths[-1]:
            able = np.flatnonzero((n0 > 0) & (n1 > 0))
            number = np.full(len(heap), -1, np.int32)
            number[able] = np.arange(len(able))
            inside = number[node] >= 0
            at, node = at[inside], number[node[inside]]
            best, feature, cut, left0, left1 = _splits(x, at, node, y, c, node_features(heap[able], x.shape[1], subset, seed, tree), n0[able], n1[able], w)
            own = n0[able] * w[0] * n1[able] * w[1] / mass[able]
            gain = 2.0 * (own - best) / mass[able]
            good = gain > 1e-12
            split[able[good]] = True
        if keep:
            f, b, g = np.full(len(heap), -1, np.int64), np.full(len(heap), -1, np.int64), np.full(len(heap), -1.0)
            if split.any():
                f[split], b[split], g[split] = feature[good], cut[good], gain[good]
            nodes.append((heap, f, b, n0, n1, g))
        if not split.any():
            continue
        feature, cut, left0, left1 = feature[good], cut[good], left0[good], left1[good]
        child = np.full(len(able), -1, np.int32)
        child[good] = np.arange(good.sum())
        on = child[node] >= 0
        at, node = at[on], child[node[on]]
        node = _below(x, at, node, feature, cut)
        child = np.full(len(heap), -1, np.int32)
        child[split] = np.arange(split.sum())
        on = child[where] >= 0
        who, where = who[on], child[where[on]]
        where = _below(x, asked[who], where, feature, cut)
        pairs = lambda a, b: np.stack([a, b], axis=1).reshape(-1)
        heap = pairs(2 * heap[split], 2 * heap[split] + 1)
        n0, n1 = pairs(left0, n0[split] - left0), pairs(left1, n1[split] - left1)
        if len(heap) <= 4 * NODES:
            todo.append((depth + 1, heap, n0, n1, at, node, who, where))
            continue
        parts = -(-len(heap) // NODES)
        dealt = []
        for rows, of in ((at, node), (who, where)):
            order = np.argsort((of // NODES).astype(np.uint16) if parts < 1 << 16 else of // NODES, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(of // NODES, minlength=parts))))
            dealt.append((rows[order], of[order], ends))
        for i in range(parts):
            a, z = i * NODES, min((i + 1) * NODES, len(heap))
            own = [(r[e[i]:e[i + 1]], o[e[i]:e[i + 1]] - np.int32(a)) for r, o, e in dealt]
            todo.append((depth + 1, heap[a:z], n0[a:z], n1[a:z], *own[0], *own[1]))
    if not keep:
        return out, None
    cols = [np.concatenate(v) for v in zip(*nodes)]
    order = np.argsort(cols[0])
    return out, [v[order] for v in cols]


# ------------------------------------------------------------------ rows


def thresholds(rows: DataFrame, column: str, width: int) -> list[list[float]]:
    """At most BINS - 1 ascending thresholds for each place of the array ``column``, from all rows: between all
    values where there are few, else at even ranks."""
    x = [F.get(column, F.lit(f)) for f in range(width)]
    shares = [i / BINS for i in range(1, BINS)]
    row = rows.agg(*[e for f in range(width) for e in (F.approx_count_distinct(x[f], 0.02).alias(f"n{f}"), F.max(x[f]).alias(f"m{f}"))]).first()
    few = [f for f in range(width) if row[f"n{f}"] <= BINS + 4]
    ranks = [F.percentile_approx(x[f], shares, SKETCH).alias(f"q{f}") for f in range(width) if f not in few]
    found = rows.agg(*[F.collect_set(x[f]).alias(f"v{f}") for f in few], *ranks).first()
    out = []
    for f in range(width):
        values = sorted(set(found[f"v{f}" if f in few else f"q{f}"] or []))
        if f in few and len(values) <= BINS:
            out.append([(a + b) / 2 for a, b in zip(values, values[1:])])
        else:
            picked = values if f not in few else [values[i * len(values) // BINS] for i in range(1, BINS)]
            out.append([v for v in picked if v < row[f"m{f}"]])
    return out


PACKED = "block bigint, keys binary, y binary, fold binary, x binary"


def packed(rows: DataFrame, label: str, id_col: str, fold_col: str, column: str, cuts: list[list[float]]) -> DataFrame:
    """Blocks of rows as bytes: keys (64-bit hashes of the id), classes, folds and bins."""
    cuts = [np.array(c) for c in cuts]

    def pack(batches):
        for i, b in enumerate(batches):
            if not b.num_rows:
                continue
            values = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            x = np.stack([np.searchsorted(c, values[:, f]) for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
            held = [np.asarray(b.column(0)).astype(np.int64), *[np.asarray(b.column(k)).astype(np.uint8) for k in (1, 2)], x]
            block = (TaskContext.get().partitionId() << 32) + i
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in held]],
                                             names=["block", "keys", "y", "fold", "x"])

    narrow = rows.select(F.xxhash64(id_col).alias("k"), (F.col(label) == 1).cast("int").alias("y"), F.col(fold_col).cast("int").alias("f"), F.col(column))
    return stored(narrow.mapInArrow(pack, PACKED), "forest-rows")


def _loaded(batches, n: int, width: int):
    """The ``n`` rows of a group as arrays: its number, its blocks, their first rows, and keys, classes, folds and bins of all rows."""
    group, blocks, first, at = None, [], [0], 0
    held = {"keys": np.empty(n, np.int64), "y": np.empty(n, np.uint8), "fold": np.empty(n, np.uint8), "x": np.empty((n, width), np.uint8)}
    for b in batches:
        for i in range(b.num_rows):
            group = b.column("g")[i].as_py()
            blocks.append(b.column("block")[i].as_py())
            for name, out in held.items():
                part = np.frombuffer(b.column(name)[i].as_buffer(), out.dtype).reshape(-1, *out.shape[1:])
                out[at:at + len(part)] = part
            at += len(part)
            first.append(at)
    if blocks and at != n:
        raise ValueError(f"group {group} has {at} of {n} rows")
    return group, blocks, np.array(first), *held.values()


def _dealt(blocks: DataFrame, groups: int) -> DataFrame:
    """Each block once for each group, and each group in a task of its own."""
    each = blocks.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"), "*")
    return each.repartitionById(groups, "g")


def _group_count(blocks: DataFrame, parts: int, n_trees: int) -> int:
    """Groups of trees for each of ``parts`` folds: as many as keep all cores busy."""
    return min(n_trees, -(-GROUPS * blocks.sparkSession.sparkContext.defaultParallelism // parts))


def held_out(blocks: DataFrame, n: int, points: Sequence[tuple[int, int]], n_folds: int, width: int, subset: int, w, seed: int) -> DataFrame:
    """``fold, y, s0, s1...``: each row's probability by the forest of each grid point (trees, depth) that was grown without its fold."""
    depths, most = sorted({d for _, d in points}), max(n for n, _ in points)
    per = _group_count(blocks, n_folds, most)

    def search(batches):
        g, names, first, keys, y, fold, x = _loaded(batches, n, width)
        if g is None:
            return
        k, own = g % n_folds, g // n_folds
        asked = np.flatnonzero(fold == k)
        sums = np.zeros((len(points), len(asked)))
        train = np.flatnonzero(fold != k)
        for tree in range(own, most, per):
            c = np.zeros(len(y), np.uint8)
            c[train] = bootstrap(keys[train], seed, tree)
            found, _ = grow(x, y, c, asked, depths, w, subset, seed, tree)
            for i, (t, d) in enumerate(points):
                if tree < t:
                    sums[i] += found[depths.index(d)]
        ends = np.searchsorted(asked, first)
        for i, block in enumerate(names):
            a, z = ends[i], ends[i + 1]
            if a < z:
                part = [[block], [k], [y[asked[a:z]].tobytes()], [sums[:, a:z].tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(part, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block", "fold", "y", "sums"])

    def added(table):
        y = np.frombuffer(table.column("y")[0].as_buffer(), np.uint8)
        total = sum(np.frombuffer(v.as_buffer(), np.float64) for v in table.column("sums")).reshape(len(points), -1)
        scores = [np.round(total[i] / t, 12) for i, (t, _) in enumerate(points)]  # sums come in any order
        return pa.table({"fold": pa.array(np.full(len(y), table.column("fold")[0].as_py(), np.int32)), "y": pa.array(y.astype(np.int32)), **{f"s{i}": s for i, s in enumerate(scores)}})

    sums = _dealt(blocks, per * n_folds).mapInArrow(search, "block bigint, fold int, y binary, sums binary")
    return sums.groupBy("block", "fold").applyInArrow(added, "fold int, y int, " + ", ".join(f"s{i} double" for i in range(len(points))))


# ------------------------------------------------------------------ the model

NODE = ("treeID int, nodeData struct<id:int,prediction:double,impurity:double,impurityStats:array<double>,rawCount:bigint,gain:double,leftChild:int,"
        "rightChild:int,split:struct<featureIndex:int,leftCategoriesOrThreshold:array<double>,numCategories:int>>")


def fitted(blocks: DataFrame, n: int, n_trees: int, depth: int, width: int, subset: int, w, seed: int, cuts: list[list[float]], estimator) -> RandomForestClassificationModel:
    """The forest over all rows, written in Spark ML's format by the tasks that grow it, and loaded."""
    spark = blocks.sparkSession
    per = _group_count(blocks, 1, n_trees)

    def trees(batches):
        g, _, _, keys, y, _, x = _loaded(batches, n, width)
        for tree in range(g, n_trees, per) if g is not None else ():
            _, (heap, f, b, n0, n1, gain) = grow(x, y, bootstrap(keys, seed, tree), np.zeros(0, np.int64), [depth], w, subset, seed, tree, keep=True)
            m0, m1 = n0 * w[0], n1 * w[1]
            mass, inner = m0 + m1, f >= 0
            # in heap order a node's number is its place, and the two below it stand side by side
            left = np.where(inner, np.searchsorted(heap, 2 * heap), -1)
            cut = [[cuts[i][j]] if i >= 0 else [] for i, j in zip(f.tolist(), b.tolist())]
            arrays = {"id": pa.array(np.arange(len(heap)).astype(np.int32)), "prediction": pa.array((m1 > m0).astype(np.float64)),
                      "impurity": pa.array(2.0 * m0 * m1 / np.maximum(mass, 1e-300) ** 2), "impurityStats": pa.array(np.stack([m0, m1], axis=1).tolist(), pa.list_(pa.float64())),
                      "rawCount": pa.array((n0 + n1).astype(np.int64)), "gain": pa.array(gain), "leftChild": pa.array(left.astype(np.int32)),
                      "rightChild": pa.array(np.where(inner, left + 1, -1).astype(np.int32))}
            split = {"featureIndex": pa.array(f.astype(np.int32)), "leftCategoriesOrThreshold": pa.array(cut, pa.list_(pa.float64())), "numCategories": pa.array(np.full(len(f), -1, np.int32))}
            arrays["split"] = pa.StructArray.from_arrays(list(split.values()), list(split))
            table = pa.table({"treeID": pa.array(np.full(len(heap), tree, np.int32)), "nodeData": pa.StructArray.from_arrays(list(arrays.values()), list(arrays))})
            yield from table.to_batches(max_chunksize=10_000)

    path = new_folder(spark, "forest")
    _dealt(blocks, per).mapInArrow(trees, NODE).write.parquet(f"{path}/data")
    params = {p.name: v for p, v in estimator._paramMap.items()} | {"numTrees": n_trees, "maxDepth": depth}
    defaults = {p.name: v for p, v in estimator._defaultParamMap.items()}
    meta = {"class": "org.apache.spark.ml.classification.RandomForestClassificationModel", "timestamp": int(time.time() * 1000), "sparkVersion": spark.version,
            "uid": estimator.uid, "paramMap": params, "defaultParamMap": defaults, "numFeatures": width, "numClasses": 2, "numTrees": n_trees}
    alone = {"bootstrap", "featureSubsetStrategy", "numTrees", "subsamplingRate"}
    each = {"class": "org.apache.spark.ml.classification.DecisionTreeClassificationModel", "timestamp": meta["timestamp"], "sparkVersion": spark.version}
    each |= {k: {n: v for n, v in held.items() if n not in alone} for k, held in (("paramMap", params), ("defaultParamMap", defaults))}
    rows = [(i, json.dumps(each | {"uid": f"{estimator.uid}_tree{i}"}), 1.0) for i in range(n_trees)]
    spark.createDataFrame(rows, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/metadata")
    return RandomForestClassificationModel.load(path)


def grid_search(train: DataFrame, label: str, id_col: str, fold_col: str = "fold", n_folds: int = 5, n_trees=(100, 200), depths=(6, 10, 30), seed: int = 42):
    """M3 + M4: class-weighted forests of every grid point, k folds by ROC-AUC over all rows, and the best one refitted on all rows.

    ``train`` has the id, the label (0, 1), ``features`` (a vector) and the fold.  Returns (model, results of the grid, rows).
    An unlimited depth is 30 (Spark's maximum).
    """
    from kestrel.operators.evaluate import roc_auc_of_scores

    rows = stored(train.select(id_col, label, fold_col, vector_to_array("features").alias("x")), "forest-input")
    width = rows.select(F.size("x")).first()[0]
    counts = {r[label]: (r["n_c"], r["weight"]) for r in P.class_weights(rows, label).collect()}
    if not counts.keys() <= {0, 1}:
        raise ValueError(f"labels must be 0 or 1, never null: {label} has {sorted(counts, key=str)[:5]}")
    n, w = sum(c for c, _ in counts.values()), [counts.get(k, (0, 0.0))[1] for k in (0, 1)]
    cuts, subset = thresholds(rows, "x", width), int(np.ceil(np.sqrt(width)))
    blocks = packed(rows, label, id_col, fold_col, "x", cuts)
    points = [(t, d) for t in n_trees for d in depths]
    scores = stored(held_out(blocks, n, points, n_folds, width, subset, w, seed), "held-out")
    found = roc_auc_of_scores(scores, "y", [F.col(f"s{i}") for i in range(len(points))], "fold", -(-n // n_folds)).collect()
    auc = {(r.s, r.g): r.roc_auc for r in found}
    results = [{"num_trees": t, "max_depth": d, "cv_roc_auc": float(np.mean([auc.get((i, k)) or 0.0 for k in range(n_folds)]))} for i, (t, d) in enumerate(points)]
    best = max(results, key=lambda r: r["cv_roc_auc"])
    rf = RandomForestClassifier(featuresCol="features", labelCol=label, weightCol="weight", featureSubsetStrategy="sqrt", seed=seed, maxBins=BINS)
    return fitted(blocks, n, best["num_trees"], best["max_depth"], width, subset, w, seed, cuts, rf), results, n
