"""R4 over whole tables: a table of queries against a table of vectors by inner product, exact or through coarse cells.

*Index.*  Coarse centres are fitted on a bounded sample (``SAMPLE`` rows of smallest id hash, Lloyd's rounds); then every row
goes to its nearest centre, and each cell's rows are packed into parts of about ``PART_ROWS`` rows with the part's mean
and radius.  A large cell is split into as many parts as it needs.  The index is a folder of Parquet, one row for each
part; ``save`` and ``load`` keep it between sessions.

*Exact search* (the default).  Queries are packed into blocks of at most ``BLOCK_BYTES`` by id range; one block at a time is
sent to all tasks.  Every query first looks into its nearest cell, which gives it a score that its k-th candidate
reaches at least; then all parts are visited, each with the queries whose bound ``q.c + |q| r`` still reaches their k-th
score, as one matrix product for ``ROWS_AT_ONCE`` queries.  Tasks keep k rows for each query and these are ranked again.

*Approximate search.*  The same pass, but a query visits only its ``probes`` cells of largest ``q.c``.  ``choose_probes`` takes
the smallest number that finds a wanted share of the true candidates of a bounded sample of rows.

Scores are rounded to nine places before they are ranked (equal scores: the smaller id).  Null vectors and those
with a component that is null or not finite take no part; shorter vectors end in zeros; repeated rows of the table are candidates of their own; query ids are unique.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kestrel.session import stored

SAMPLE = 16384
MAX_CELLS = 512
ROUNDS = 6
PART_ROWS = 4096
BLOCK_BYTES = 4 << 20
ROWS_AT_ONCE = 1024
PROBE_SAMPLE, PROBE_TARGET = 256, 0.95

PARTS = "cell int, centre binary, mean binary, radius double, ids array<bigint>, docs array<string>, vectors binary"
FOUND = "query_id long, cand_id long, cand_doc string, score double, cell int"


@dataclass
class VectorIndex:
    """``parts``: one row for each part of a cell; ``centres``: the cells' centres, in cell order."""

    parts: DataFrame
    centres: np.ndarray

    @property
    def dim(self) -> int:
        return self.centres.shape[1]

    def save(self, path: str) -> None:
        self.parts.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> VectorIndex:
    """An index that ``save`` wrote; cells without rows are left out of it and keep no place."""
    parts = spark.read.parquet(path)
    held = parts.groupBy("cell").agg(F.first("centre").alias("centre")).orderBy("cell").collect()  # MAX_CELLS rows at most
    centres = np.array([np.frombuffer(r["centre"]) for r in held])
    place = F.create_map(*[F.lit(x) for i, r in enumerate(held) for x in (r["cell"], i)]) if held else None
    return VectorIndex(parts.withColumn("cell", F.element_at(place, F.col("cell"))) if held else parts, centres.reshape(len(held), -1))


def matrix(column, dim: int) -> np.ndarray:
    """A list column as a matrix of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(np.asarray(column.offsets)).astype(np.int64)
    out = np.zeros((len(size), dim))
    out[np.repeat(np.arange(len(size)), size), np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)] = np.asarray(column.flatten().fill_null(float("nan")))
    return out


# ------------------------------------------------------------------ index
def nearest(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (vectors @ centres.T - 0.5 * (centres ** 2).sum(axis=1)).argmax(axis=1)


def fit_centres(sample: np.ndarray, cells: int, seed: int = 7) -> np.ndarray:
    """Lloyd's rounds over the sample; a centre that loses its rows stays where it was."""
    if not len(sample):
        return np.zeros((0, sample.shape[1]))
    centres = sample[np.random.default_rng(seed).choice(len(sample), min(cells, len(sample)), replace=False)].copy()
    for _ in range(ROUNDS):
        own = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centres))
        centres[size > 0] = sums[size > 0] / size[size > 0][:, None]
    return centres


def sound(*arrays):
    """The rows of ``arrays`` whose vector (the last one) is finite."""
    keep = np.isfinite(arrays[-1]).all(axis=1)
    return tuple(a[keep] for a in arrays)


def _assigned(batches, centres):
    dim = centres.shape[1]
    for batch in batches:
        vectors = matrix(batch.column(2), dim)
        batch = batch.filter(pa.array(np.isfinite(vectors).all(axis=1)))
        vectors, = sound(vectors)
        cell = np.concatenate([nearest(vectors[a:a + 4096], centres) for a in range(0, len(vectors), 4096)] or [np.zeros(0, int)])
        offs = pa.py_buffer(np.arange(len(vectors) + 1, dtype=np.int32) * np.int32(8 * dim))
        raw = pa.Array.from_buffers(pa.binary(), len(vectors), [None, offs, pa.py_buffer(vectors.tobytes())])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell, pa.int32()), raw], names=["id", "doc", "cell", "vector"])


def _packed(group: pa.Table, centres: np.ndarray) -> pa.Table:
    dim, cell = centres.shape[1], group["cell"][0].as_py()
    vectors = np.frombuffer(b"".join(group["vector"].to_pylist())).reshape(group.num_rows, dim)
    mean = vectors.mean(axis=0)
    radius = float(np.sqrt(((vectors - mean) ** 2).sum(axis=1).max()))
    return pa.table({"cell": pa.array([cell], pa.int32()), "centre": [centres[cell].tobytes()], "mean": [mean.tobytes()], "radius": [radius],
                     "ids": pa.array([group["id"].to_pylist()], pa.list_(pa.int64())), "docs": pa.array([group["doc"].to_pylist()], pa.list_(pa.string())), "vectors": [vectors.tobytes()]})


def build(corpus: DataFrame, cells: int | None = None, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> VectorIndex:
    """Index every row of ``corpus`` (id, doc, embedding); ``cells``: the square root of the rows, MAX_CELLS at most."""
    rows = corpus.select(F.col("id").cast("long").alias("id"), F.col("doc").cast("string").alias("doc"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    dim = dim or 0
    cells = cells or max(1, min(MAX_CELLS, int(np.ceil(np.sqrt(n)))))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding").toArrow()["embedding"]
    centres = fit_centres(*sound(matrix(chosen, dim)), cells)
    if not len(centres):
        centres = np.zeros((1, dim))
    dealt = stored(rows.mapInArrow(lambda it: _assigned(it, centres), "id long, doc string, cell int, vector binary"), "vector-cells")
    sizes = {r["cell"]: r["count"] for r in dealt.groupBy("cell").count().collect()}  # MAX_CELLS rows at most
    split = F.create_map(*[F.lit(x) for c, size in sizes.items() for x in (c, -(-size // part_rows))]) if sizes else F.create_map(F.lit(0), F.lit(1))
    # the stored table's row numbers spread even the copies of one row over its cell's parts
    part = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.element_at(split, F.col("cell")))
    n_parts = max(1, sum(-(-size // part_rows) for size in sizes.values()))
    tasks = min(n_parts, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    packed = dealt.withColumn("part", part).repartition(tasks, "cell", "part").groupBy("cell", "part").applyInArrow(lambda t: _packed(t, centres), PARTS)
    return VectorIndex(stored(packed, "vector-index"), centres)


# ------------------------------------------------------------------ search
class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None):
        self.k, self.floor = k, np.full(n, -np.inf) if floor is None else floor
        self.scores, self.ids, self.docs, self.cells = np.full((n, k), -np.inf), np.zeros((n, k), np.int64), np.full((n, k), None, object), np.zeros((n, k), np.int32)

    def reach(self) -> np.ndarray:
        """The score that a new candidate must reach."""
        return np.maximum(self.floor, self.scores[:, -1])

    def add(self, queries: np.ndarray, scores: np.ndarray, ids: np.ndarray, docs: np.ndarray, cell: int) -> None:
        least = self.reach()[queries]
        if scores.shape[1] > self.k:
            least = np.maximum(least, np.partition(scores, scores.shape[1] - self.k, axis=1)[:, scores.shape[1] - self.k])
        row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(row):
            return
        some = np.unique(queries[row])
        old, at = np.nonzero(self.scores[some] > -np.inf)
        old = some[old]
        q = np.concatenate([old, queries[row]])
        s = np.concatenate([self.scores[old, at], scores[row, col]])
        i = np.concatenate([self.ids[old, at], ids[col]])
        d = np.concatenate([self.docs[old, at], docs[col]])
        c = np.concatenate([self.cells[old, at], np.full(len(row), cell, np.int32)])
        order = np.lexsort((i, -s, q))
        q = q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        q, rank, order = q[keep], rank[keep], order[keep]
        self.scores[some] = -np.inf
        self.scores[q, rank], self.ids[q, rank], self.docs[q, rank], self.cells[q, rank] = s[order], i[order], d[order], c[order]


def _probed(queries: np.ndarray, centres: np.ndarray, probes: int) -> np.ndarray:
    """Which cells each query visits: the ``probes`` cells of largest inner product (equal ones: the first)."""
    order = np.argsort(-(queries @ centres.T), axis=1, kind="stable")[:, :probes]
    out = np.zeros((len(queries), len(centres)), bool)
    np.put_along_axis(out, order, True, axis=1)
    return out


def _visit(batches, sent, k: int, exclude_self: bool, probes: int | None):
    ids, queries, centres, floor = sent.value
    best = Best(len(ids), k, floor)
    length = np.sqrt((queries ** 2).sum(axis=1))
    visits = _probed(queries, centres, probes) if probes else None
    for batch in batches:
        for i in range(batch.num_rows):
            part = {c: batch.column(j)[i] for j, c in enumerate(batch.schema.names)}
            cell, own = part["cell"].as_py(), np.asarray(part["ids"].values)
            live = np.flatnonzero(visits[:, cell]) if probes else np.flatnonzero(
                queries @ np.frombuffer(part["mean"].as_py()) + length * part["radius"].as_py() + 1e-6 >= best.reach())
            if not len(live):
                continue
            vectors = np.frombuffer(part["vectors"].as_py()).reshape(len(own), -1)
            docs = np.array(part["docs"].as_py(), object)
            order = np.argsort(own, kind="stable")
            for at in range(0, len(live), ROWS_AT_ONCE):
                some = live[at:at + ROWS_AT_ONCE]
                scores = np.round(queries[some] @ vectors.T, 9)
                if exclude_self:
                    first, last = np.searchsorted(own[order], ids[some], "left"), np.searchsorted(own[order], ids[some], "right")
                    for q in np.flatnonzero(last > first):
                        scores[q, order[first[q]:last[q]]] = -np.inf
                best.add(some, scores, own, docs, cell)
    row, col = np.nonzero(best.scores > -np.inf)
    yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(best.ids[row, col]), pa.array(best.docs[row, col], pa.string()), pa.array(best.scores[row, col]),
                                      pa.array(best.cells[row, col], pa.int32())], names=["query_id", "cand_id", "cand_doc", "score", "cell"])


def _blocks(batches, dim: int, rows: int):
    """Queries of a task packed into blocks of ``rows`` at most."""
    ids, vectors, held, number = [], [], 0, 0

    def packed():
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(vectors).tobytes()], pa.binary())], names=["number", "ids", "vectors"])

    for batch in batches:
        own, found = sound(np.asarray(batch.column(0)), matrix(batch.column(1), dim))
        at = 0
        while at < len(own):
            take = min(rows - held, len(own) - at)
            ids.append(own[at:at + take])
            vectors.append(found[at:at + take])
            at, held = at + take, held + take
            if held == rows:
                yield packed()
                ids, vectors, held, number = [], [], 0, number + 1
    if held:
        yield packed()


def _pass(index: VectorIndex, block, k: int, exclude_self: bool, probes: int | None, floor=None) -> DataFrame:
    ids, vectors = block
    sent = index.parts.sparkSession.sparkContext.broadcast((ids, vectors, index.centres, floor))
    found = index.parts.select("cell", "mean", "radius", "ids", "docs", "vectors").mapInArrow(lambda it: _visit(it, sent, k, exclude_self, probes), FOUND)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("cand_id").asc())
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def search(index: VectorIndex, queries: DataFrame, k: int, exclude_self: bool = False, probes: int | None = None, block_rows: int | None = None) -> DataFrame:
    """For every row of ``queries`` (query_id, embedding; a table of any size) the k best rows of the index:
    ``query_id, rank, cand_id, cand_doc, score, cell``; exact unless ``probes`` is given."""
    spark, dim = queries.sparkSession, index.dim
    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null")
    # a query that is longer than the rows meets zeros there
    rows = rows.withColumn("embedding", F.slice("embedding", 1, max(dim, 1))) if dim else rows.withColumn("embedding", F.slice("embedding", 1, 0))
    block_rows = block_rows or max(1, BLOCK_BYTES // (8 * max(dim, 1)))
    n_blocks = max(1, -(-rows.count() // block_rows))
    ranged = rows.repartitionByRange(n_blocks, "query_id").mapInArrow(lambda it: _blocks(it, dim, block_rows), "number int, ids binary, vectors binary").withColumn("task", F.spark_partition_id())
    blocks = stored(ranged, "query-blocks")
    out = None
    for r in blocks.select("task", "number").orderBy("task", "number").collect():  # one small row for each block
        raw = blocks.where((F.col("task") == r["task"]) & (F.col("number") == r["number"])).select("ids", "vectors").first()  # BLOCK_BYTES at most
        ids = np.frombuffer(raw["ids"], np.int64)
        block = ids, np.frombuffer(raw["vectors"]).reshape(len(ids), dim)
        floor = None
        if probes is None:
            seeds = {s["query_id"]: s["score"] for s in _pass(index, block, k, exclude_self, 1).where(F.col("rank") == k).select("query_id", "score").collect()}
            floor = np.array([seeds.get(i, -np.inf) for i in ids.tolist()])
        part = stored(_pass(index, block, k, exclude_self, probes, floor).select("query_id", "rank", "cand_id", "cand_doc", "score", "cell"), "vector-found")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "query_id long, rank int, cand_id long, cand_doc string, score double, cell int")


def choose_probes(index: VectorIndex, corpus: DataFrame, k: int, target: float = PROBE_TARGET, sample: int = PROBE_SAMPLE) -> int:
    """The smallest number of cells in which a query finds ``target`` of its true candidates, over a bounded sample of rows."""
    queries = corpus.where("embedding is not null").orderBy(F.xxhash64("id", F.lit(1)), "id").limit(sample).select(F.col("id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    rows = queries.toArrow()
    vectors = dict(zip(rows["query_id"].to_pylist(), matrix(rows["embedding"].cast(pa.list_(pa.float64())), index.dim)))
    true = search(index, queries, k, exclude_self=True).select("query_id", "cell").collect()  # k rows for each of the sample
    if not true:
        return 1
    order = np.argsort(np.argsort(-(np.array([vectors[r["query_id"]] for r in true]) @ index.centres.T), axis=1, kind="stable"), axis=1)
    return int(np.sort(order[np.arange(len(true)), [r["cell"] for r in true]])[int(np.ceil(target * len(true))) - 1]) + 1


def recall(exact: DataFrame, approximate: DataFrame) -> DataFrame:
    """One row: how many of the exact candidates the approximate search found, and their share."""
    hit = approximate.select("query_id", "cand_id", F.lit(1).alias("hit")).distinct()
    return exact.select("query_id", "cand_id").join(hit, ["query_id", "cand_id"], "left").agg(
        F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_true"), F.count("hit").alias("n_found"),
        F.round(F.count("hit") / F.count(F.lit(1)), 4).alias("recall"))
