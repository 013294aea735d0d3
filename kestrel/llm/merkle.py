"""Merkle manifest of a dataset: subtree roots of aligned partitions, exchanged round by round as in a butterfly.

Every row is a leaf (its hash over length-prefixed fields); the leaves of a source, in id order, form a tree of
fanout three, and the sources' roots, in byte order, form the tree above them.  One routine serves both:

1. *Positions.*  A range partitioning by group and order splits a hot group over many tasks; a row's position is its
   place in its run inside the task plus the rows of the group in earlier tasks, which only a task's first group needs.
2. *Aligned partitions.*  ``FANOUT ** DEPTH`` consecutive leaves are one partition (a packed row); it hashes its levels.
3. *Butterfly.*  In round r, the partitions with the same place inside their subtrees of ``FANOUT ** r`` partitions swap
   subtree roots with those of the other subtrees below the same parent; each hashes the parent redundantly and keeps
   the roots it received as its next siblings.  The last, shorter subtree serves the places it lacks by its own members in
   turn.  After the last round every partition holds its upper proof: there is no pass from the root down.  A round deals
   at most three rows to a key.
4. Each partition then finishes its own leaves: proof and folded root.

Defined results: a null field hashes as ``-``; a null id comes first in its source, a null source first of all, equal ids
are ordered by leaf, so repeated rows have results of their own; a null id counts as the empty text for the choice of
tampered rows; an empty table gives no rows.  A text is hashed whole in the JVM, however long it is, and is never
shuffled.  Other columns are ignored, whatever their names.
"""
from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kestrel.llm.shared import written

FANOUT = 3
DEPTH = 6  # levels inside a partition: 729 leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(parts: str) -> str:
    return hashlib.sha256(parts.encode()).hexdigest()


# ------------------------------------------------------------------ leaves
def field(c: Column) -> Column:
    """``-`` for a null, else the UTF-8 byte count, a colon and the value."""
    text = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """``source, doc_id, leaf, changed``: ``changed`` is the leaf of a row that tampering alters, else null."""
    docs = docs.select(*[F.col(f"`{c}`") for c in FIELDS])
    chosen = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(2)) == 0
    own = [F.col(c) for c in FIELDS]
    cut = [F.translate("text", "\n", "") if c == "text" else F.col(c) for c in FIELDS]
    changed = F.when(chosen & F.contains(F.col("text"), F.lit("\n")), leaf(cut))
    return docs.select("source", "doc_id", leaf(own).alias("leaf"), changed.alias("changed"))


# ------------------------------------------------------------------ positions
def _runs(batches, group: str):
    """Adds ``run``: how many rows of the same group came before in this task (rows arrive sorted by group)."""
    last, seen = None, 0
    for batch in batches:
        run = []
        for g in batch.column(batch.schema.get_field_index(group)).to_pylist():
            seen = seen + 1 if last == (g,) else 0
            last = (g,)
            run.append(seen)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64())], names=[*batch.schema.names, "run"])


def positions(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``pos``: the place inside the group by ``order`` (nulls first), from 0."""
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(c).asc_nulls_first() for c in (group, *order)]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    local = written(ranged.mapInArrow(lambda it: _runs(it, group), f"{kinds}, run bigint").withColumn("task", F.spark_partition_id()), "merkle-runs")
    # a task's first group may go on from earlier tasks: at most two groups of a task reach over its edges
    sizes = local.groupBy("task", F.col(group).alias("g")).agg(F.count("*").alias("n"))
    edge = Window.partitionBy("task")
    held = F.struct(F.col("g"))
    sizes = sizes.withColumn("first", F.min(held).over(edge)).withColumn("last", F.max(held).over(edge)).filter(
        held.eqNullSafe(F.col("first")) | held.eqNullSafe(F.col("last")))
    before = Window.partitionBy("g").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).filter(held.eqNullSafe(F.col("first")) & (F.col("before") > 0))
    carry = F.broadcast(carry.select(F.col("task").alias("at"), "g", "before"))  # one row for each task at most
    out = local.join(carry, (local["task"] == carry["at"]) & local[group].eqNullSafe(carry["g"]), "left")
    return out.select(*[local[c] for c in rows.columns], (F.col("run") + F.coalesce("before", F.lit(0))).alias("pos"))


# ------------------------------------------------------------------ trees
def raised(nodes: list[str], levels: int | None) -> list[list[str]]:
    """All levels above ``nodes``: up to one node, or exactly ``levels`` of them."""
    out = [nodes]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        now = out[-1]
        out.append([digest("".join(now[i:i + FANOUT])) for i in range(0, len(now), FANOUT)])
    return out


def _tops(batches, depth: int):
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index("rows"))
        nodes, tops = [], []
        for held in rows:
            hashes = [r["leaf"] for r in held.as_py()]
            nodes.append(raised(hashes, depth)[-1][0])
            tops.append(raised(hashes, None)[-1][0])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(nodes, pa.string()), pa.array(tops, pa.string())], names=[*batch.schema.names, "node", "top"])


def partitions(rows: DataFrame, group: str, depth: int = DEPTH) -> DataFrame:
    """Rows with ``pos`` and ``leaf`` packed into aligned partitions: ``g, part, rows``, the root ``node`` at level ``depth``
    and the root ``top`` of a tree that ends inside the partition."""
    own = [c for c in rows.columns if c not in (group, "pos")]
    packed = rows.groupBy(F.col(group).alias("g"), F.floor(F.col("pos") / FANOUT ** depth).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("pos", *own))).alias("rows"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.schema)
    return written(packed.mapInArrow(lambda it: _tops(it, depth), f"{kinds}, node string, top string"), "merkle-partitions")


def butterfly(packed: DataFrame) -> DataFrame:
    """``g, part, parts, n`` (partitions and leaves of the group), ``path`` (siblings above the partition) and ``root``."""
    sizes = packed.groupBy("g").agg((F.max("part") + 1).alias("parts"), F.sum(F.size("rows")).alias("n")).withColumnRenamed("g", "of")
    state = packed.select("g", "part", "node", "top").join(sizes, F.col("g").eqNullSafe(F.col("of"))).select(
        "g", "part", "parts", "n", F.lit("").alias("path"), F.when(F.col("parts") == 1, F.col("top")).otherwise(F.col("node")).alias("node"))
    state = written(state, "merkle-round")
    most = state.agg(F.max("parts")).first()[0] or 0
    width, done = 1, []
    while width < most:
        done.append(state.filter(F.col("parts") <= width))
        state = written(_swap(state.filter(F.col("parts") > width), width), "merkle-round")
        width *= FANOUT
    for d in done:
        state = state.unionByName(d)
    return state.withColumnRenamed("node", "root")


def _swap(state: DataFrame, width: int) -> DataFrame:
    """One round: subtrees of ``width`` partitions become subtrees of ``FANOUT * width``."""
    sub = F.floor(F.col("part") / width)
    size = F.least(F.lit(width).cast("bigint"), F.col("parts") - sub * width)
    place = F.col("part") % width
    # a subtree shorter than the others answers for the places it lacks by its members in turn
    places = F.sequence(place, F.lit(width - 1).cast("bigint"), size)
    sent = state.withColumn("above", F.floor(sub / FANOUT)).withColumn("child", sub % FANOUT).withColumn("place", F.explode(places))
    own = F.when(F.col("place") == F.col("part") % width, F.struct("part", "parts", "n", "path"))
    met = sent.groupBy("g", "above", "place").agg(F.sort_array(F.collect_list(F.struct("child", "node", own.alias("own")))).alias("met"))
    got = met.withColumn("one", F.explode("met")).filter("one.own is not null")
    others = F.transform(F.filter("met", lambda x: x["child"] != F.col("one.child")), lambda x: x["node"])
    return got.select("g", "one.own.part", "one.own.parts", "one.own.n", F.concat("one.own.path", F.concat_ws("", others)).alias("path"),
                      F.sha2(F.concat_ws("", F.transform("met", lambda x: x["node"])), 256).alias("node"))


# ------------------------------------------------------------------ proofs
def steps(pos: int, n: int, siblings: str) -> list[tuple[str, str]]:
    """(hashes left, hashes right) of a node on its way up, from the row of its siblings."""
    out, at = [], 0
    while n > 1:
        left = pos % FANOUT
        right = min(FANOUT, n - pos + left) - left - 1
        out.append((siblings[at:at + 64 * left], siblings[at + 64 * left:at + 64 * (left + right)]))
        at += 64 * (left + right)
        pos, n = pos // FANOUT, -(-n // FANOUT)
    return out


def own_siblings(levels: list[list[str]], i: int) -> str:
    """Siblings of leaf ``i`` inside its partition."""
    out = []
    for nodes in levels[:-1]:
        first = i - i % FANOUT
        out += nodes[first:i] + nodes[i + 1:first + FANOUT]
        i //= FANOUT
    return "".join(out)


OUT = pa.schema([("doc_id", pa.int64()), *[(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())])
FLUSH = 4096  # rows of a result batch, about


def _one_by_one(batches):
    """Packed partitions as dictionaries, one at a time, so that memory holds the leaves of one."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _finished(batches, depth: int):
    out = {c: [] for c in OUT.names}
    for p in _one_by_one(batches):
        levels = raised([r["leaf"] for r in p["rows"]], depth if p["parts"] > 1 else None)
        above = steps(p["source_pos"], p["sources"], p["source_path"])
        for i, row in enumerate(p["rows"]):
            path = own_siblings(levels, i) + p["path"]
            now = row["changed"] or row["leaf"]
            for left, right in steps(p["part"] * FANOUT ** depth + i, p["n"], path) + above:
                now = digest(left + now + right)
            for k, v in zip(out, (row["doc_id"], row["leaf"], p["subroot"], p["root"], digest(path + p["source_path"]), now, now == p["root"])):
                out[k].append(v)
        if len(out["leaf"]) >= FLUSH:
            yield pa.RecordBatch.from_pydict(out, OUT)
            out = {c: [] for c in OUT.names}
    yield pa.RecordBatch.from_pydict(out, OUT)


PLACES = pa.schema([("source", pa.string()), ("source_pos", pa.int64()), ("sources", pa.int64()), ("source_path", pa.string()), ("root", pa.string())])


def _siblings(batches, depth: int):
    """Of the upper tree: each source's place and whole row of siblings."""
    for p in _one_by_one(batches):
        levels = raised([r["leaf"] for r in p["rows"]], depth if p["parts"] > 1 else None)
        yield pa.RecordBatch.from_pylist([{"source": r["source"], "source_pos": r["pos"], "sources": p["n"], "source_path": own_siblings(levels, i) + p["path"], "root": p["root"]}
                                          for i, r in enumerate(p["rows"])], PLACES)


def manifest(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row."""
    # written before the range partitioning, whose sampling would hash every text a second time
    packed = partitions(positions(written(leaves(docs), "merkle-leaves"), "source", ["doc_id", "leaf"]), "source", depth)
    trees = written(butterfly(packed), "merkle-trees")
    tops = trees.filter("part = 0").select(F.lit(0).alias("one"), F.col("g").alias("source"), F.col("root").alias("leaf"))
    upper = partitions(positions(tops, "one", ["source"]), "one", depth)
    ends = _joined(upper, butterfly(upper)).select("rows", "part", "parts", "n", "path", "root").mapInArrow(
        lambda it: _siblings(it, depth), "source string, source_pos bigint, sources bigint, source_path string, root string")
    ends = written(ends, "merkle-sources")
    trees = trees.withColumnRenamed("root", "subroot").join(ends, F.col("g").eqNullSafe(F.col("source"))).select(
        "g", "part", "parts", "n", "path", "subroot", "source_pos", "sources", "source_path", "root")
    return _joined(packed, trees).drop("g").mapInArrow(
        lambda it: _finished(it, depth), "doc_id bigint, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def _joined(packed: DataFrame, trees: DataFrame) -> DataFrame:
    """Packed partitions with what the butterfly brought them."""
    trees = trees.withColumnsRenamed({"g": "g2", "part": "part2"})
    return packed.select("g", "part", "rows").join(trees, F.col("g").eqNullSafe(F.col("g2")) & (F.col("part") == F.col("part2"))).drop("g2", "part2")


# ------------------------------------------------------------------ SQL
def manifest_sql(levels: int = 24) -> str:
    """The same in DuckDB SQL, one set of tables for each level (``levels`` bound the rows at ``FANOUT ** levels``)."""
    bits = "list_transform(range(0, 8 * length(s)), lambda i: (ascii(substr(s, CAST(i // 8 AS INTEGER) + 1, 1)) >> CAST(i % 8 AS INTEGER)) & 1)"
    crc = f"xor(list_reduce(list_concat([4294967295::BIGINT], {bits}), lambda c, b: xor(c >> 1, 3988292384 * xor(c & 1, b))), 4294967295)"

    def field(c):
        return f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || CAST({c} AS VARCHAR) END"

    def leaf(text):
        return "sha256(" + " || ".join(field(text if c == "text" else c) for c in FIELDS) + ")"

    sql = [f"""base AS (SELECT row_number() OVER () AS rid, *, coalesce(CAST(doc_id AS VARCHAR), '') AS s FROM documents),
hashed AS (SELECT rid, doc_id, source, {leaf('text')} AS leaf,
  CASE WHEN ({crc}) % 2 = 0 AND contains(text, chr(10)) THEN {leaf("replace(text, chr(10), '')")} END AS changed FROM base),
a0 AS (SELECT rid, doc_id, source AS g, leaf, changed, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
  count(*) OVER (PARTITION BY source) AS n FROM hashed),
an0 AS (SELECT g, pos, n, leaf AS node FROM a0)"""]

    def climb(t):
        # a run of one node becomes its hash while the group holds several nodes; a group of one node stays as it is
        for i in range(levels):
            sql.append(f"""{t}{i + 1} AS (SELECT g, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END AS pos, CASE WHEN any_value(n) > 1 THEN (any_value(n) + {FANOUT - 1}) // {FANOUT} ELSE 1 END AS n,
  CASE WHEN any_value(n) > 1 THEN sha256(string_agg(node, '' ORDER BY {t}{i}.pos)) ELSE any_value(node) END AS node FROM {t}{i} GROUP BY g, CASE WHEN n > 1 THEN pos // {FANOUT} ELSE pos END)""")

    def proofs(t, start, name):
        """Siblings of every starting row level by level, and the hash folded through them."""
        sql.append(f"{name}0 AS ({start})")
        for i in range(levels):
            sql.append(f"""{name}{i + 1} AS (SELECT p.rid, p.g, any_value(p.pos) // {FANOUT} AS pos, any_value(p.path) || coalesce(string_agg(x.node, '' ORDER BY x.pos) FILTER (WHERE x.pos <> p.pos AND x.n > 1), '') AS path,
  CASE WHEN any_value(x.n) > 1 THEN sha256(string_agg(CASE WHEN x.pos = p.pos THEN p.folded ELSE x.node END, '' ORDER BY x.pos)) ELSE any_value(p.folded) END AS folded
  FROM {name}{i} p JOIN {t}{i} x ON x.g IS NOT DISTINCT FROM p.g AND x.pos // {FANOUT} = p.pos // {FANOUT} GROUP BY p.rid, p.g)""")

    climb("an")
    proofs("an", "SELECT rid, g, pos, '' AS path, coalesce(changed, leaf) AS folded FROM a0", "ap")
    sql.append(f"bn0 AS (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, node, g AS source FROM an{levels})")
    climb("bn")
    proofs("bn", f"SELECT p.rid, 0 AS g, b.pos, p.path, p.folded FROM ap{levels} p JOIN bn0 b ON b.source IS NOT DISTINCT FROM p.g", "bp")
    return "WITH " + ",\n".join(sql) + f"""
SELECT a.doc_id, a.leaf, s.node AS subroot, r.node AS root, sha256(p.path) AS proof_sha256, p.folded AS folded_root, p.folded = r.node AS verified
FROM a0 a JOIN bp{levels} p ON p.rid = a.rid JOIN bn0 s ON s.source IS NOT DISTINCT FROM a.g, bn{levels} r"""
