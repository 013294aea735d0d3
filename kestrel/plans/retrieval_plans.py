"""Retrieval queries: chunking of ``documents``, text retrieval and exact top-k over ``embeddings``.

The query side is bounded by what it means, the other side is a whole table.  Vectors: the mean vector of each class
is the query, every vector a candidate, its label the document.  Texts: the queries of the answer key against
every sentence chunk of the knowledge base and of ``documents`` together; the relevant documents are those the
answer key names, so every chunk of ``documents`` that ranks among the best costs precision.
"""
from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions import policy_kb as KB
from kestrel.functions import text_rules as T
from kestrel.operators import messages as MS
from kestrel.operators import postings as PO
from kestrel.operators import retrieval as RT
from kestrel.operators import vector_index as VI
from kestrel.plans.registry import register
from kestrel.sources.tables import read_table, spread


def vector_corpus(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return v.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc"), "embedding")


QUERY_EVERY = 20


def vector_queries(spark, sf_dir):
    """The stated query set: every vector whose id is divisible by 20, against all vectors but itself."""
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return v.where(F.col("vec_id") % QUERY_EVERY == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def vector_topk(spark, sf_dir, k: int = RT.TOP_K):
    return RT.topk_inner_product(vector_queries(spark, sf_dir), vector_corpus(spark, sf_dir), k, exclude_self=True)


def class_queries(spark, sf_dir):
    """One query for each class: its mean vector."""
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return MS.class_means(v, len(T.CLASS_NAMES)).select(F.col("label").cast("long").alias("query_id"), "embedding")


def class_topk(spark, sf_dir, k: int = RT.TOP_K):
    return RT.topk_inner_product(class_queries(spark, sf_dir), vector_corpus(spark, sf_dir), k)


def _ranked_sql(queries: str, on: str) -> str:
    return f"""{queries},
pairs AS (
  SELECT q.query_id, c.vec_id AS cand_id, CAST(c.label AS VARCHAR) AS cand_doc, round(list_dot_product(CAST(c.embedding AS DOUBLE[]), q.v), 9) AS score
  FROM vq q JOIN embeddings c ON {on}),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, cand_id ASC) AS INTEGER) AS rank
           FROM pairs),
topk AS (SELECT * FROM ranked WHERE rank <= {RT.TOP_K})"""


_TOPK_CTE = _ranked_sql(f"vq AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % {QUERY_EVERY} = 0)", "c.vec_id <> q.query_id")
_CLASS_CTE = _ranked_sql("""el AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
vq AS (SELECT CAST(label AS BIGINT) AS query_id, list(m ORDER BY pos) AS v FROM (
         SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM el GROUP BY label, pos) GROUP BY label)""", "true")


def _topk_sql(cte: str) -> str:
    return f"WITH {cte} SELECT query_id, rank, cand_id AS chunk_id, cand_doc AS doc_id, round(score, 4) AS score FROM topk"


def _grounded_sql(cte: str) -> str:
    return (f"WITH {cte} SELECT q.query_id, round(coalesce(t.score, 0.0), 4) AS top_score, coalesce(t.score, 0.0) >= {RT.GROUNDEDNESS_THRESHOLD} AS grounded "
            "FROM vq q LEFT JOIN topk t ON t.query_id = q.query_id AND t.rank = 1")


def _shown(topk):
    return topk.select("query_id", "rank", F.col("cand_id").alias("chunk_id"), F.col("cand_doc").alias("doc_id"), F.round("score", 4).alias("score"))


@register("topk_vectors", _topk_sql(_TOPK_CTE))
def q_topk_vectors(spark, sf_dir):
    return _shown(vector_topk(spark, sf_dir))


@register("groundedness", _grounded_sql(_TOPK_CTE))
def q_groundedness(spark, sf_dir):
    return RT.groundedness(vector_queries(spark, sf_dir), vector_topk(spark, sf_dir))


@register("class_mean_topk", _topk_sql(_CLASS_CTE))
def q_class_mean_topk(spark, sf_dir):
    return _shown(class_topk(spark, sf_dir))


@register("class_mean_groundedness", _grounded_sql(_CLASS_CTE))
def q_class_mean_groundedness(spark, sf_dir):
    return RT.groundedness(class_queries(spark, sf_dir), class_topk(spark, sf_dir))


def _approximate(spark, sf_dir):
    corpus = vector_corpus(spark, sf_dir)
    index = VI.build(corpus)
    probes = VI.choose_probes(index, corpus, RT.TOP_K)
    return index, VI.search(index, vector_queries(spark, sf_dir), RT.TOP_K, exclude_self=True, probes=probes)


@register("topk_vectors_cells")
def q_topk_vectors_cells(spark, sf_dir):
    """R4 through coarse cells: the query set of ``topk_vectors``, each query in the cells that its calibration asks for."""
    return _shown(_approximate(spark, sf_dir)[1])


@register("vector_cells_recall")
def q_vector_cells_recall(spark, sf_dir):
    """Recall at 3 of the cells against exact search over the same query set (at least 0.9)."""
    index, found = _approximate(spark, sf_dir)
    return VI.recall(VI.search(index, vector_queries(spark, sf_dir), RT.TOP_K, exclude_self=True), found)


@register("vector_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 6) AS norm "
          "FROM embeddings")
def q_vector_norms(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding"])
    return RT.vector_norms(v).select("vec_id", F.round("norm", 6).alias("norm"))


@register("vector_table_stats", "SELECT count(*) AS n_vectors, CAST(max(len(embedding)) AS INTEGER) AS dim, "
          "count(DISTINCT label) AS n_labels, CAST(1 AS DOUBLE) AS mean_norm FROM embeddings")
def q_vector_table_stats(spark, sf_dir):
    """The unit-length vector table written by the sink and read back."""
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    sinks.write_vector_table(read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]), path)
    v = RT.vector_norms(spark.read.parquet(path))
    return v.agg(F.count(F.lit(1)).alias("n_vectors"), F.max(F.size("embedding")).alias("dim"),
                 F.countDistinct("label").alias("n_labels"), F.round(F.avg("norm"), 6).alias("mean_norm"))


def chunk_sql() -> str:
    """Sentences of ``documents``; white space is that of Unicode on both sides."""
    sp = r"[\s\v\x{85}\p{Z}]"
    return f"""parts AS (
  SELECT doc_id, list_filter(list_transform(
           string_split(regexp_replace(regexp_replace(text, '^{sp}+|{sp}+$', '', 'g'), '([.!?]){sp}+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)),
           lambda s: regexp_replace(s, '^{sp}+|{sp}+$', '', 'g')), lambda s: s <> '') AS p
  FROM documents),
chunks AS (
  SELECT printf('%s-%02d', CAST(doc_id AS VARCHAR), idx) AS chunk_id, doc_id, idx, text FROM (
    SELECT doc_id, unnest(p) AS text, CAST(generate_subscripts(p, 1) - 1 AS INTEGER) AS idx FROM parts))"""


_CHUNK_CTE = chunk_sql()


def term_sql(text: str) -> str:
    return f"unnest(regexp_extract_all(lower({text}), '{RT.TERM}'))"


@register("sentence_chunks", f"WITH {_CHUNK_CTE} SELECT chunk_id, doc_id, idx, text FROM chunks")
def q_sentence_chunks(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    return RT.sentence_chunks(docs)


@register("chunk_ids", f"WITH {_CHUNK_CTE} SELECT doc_id, count(*) AS n_chunks, max(chunk_id) AS last_chunk_id, "
          "CAST(sum(length(text)) AS BIGINT) AS chunk_chars FROM chunks GROUP BY doc_id")
def q_chunk_ids(spark, sf_dir):
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    c = RT.sentence_chunks(docs)
    return c.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.max("chunk_id").alias("last_chunk_id"),
                                   F.sum(F.length("text")).cast("long").alias("chunk_chars"))



# ------------------------------------------------------------------ answer key against all chunks
QUERIES_OF_KEY = [(i, q) for i, (q, _) in enumerate(KB.ANSWER_KEY)]


def all_chunks(spark, sf_dir):
    """Sentence chunks of the knowledge base and of every document, with their document as text."""
    base = spark.createDataFrame([(d, t) for d, _, t in KB.DOCUMENTS], "doc_id string, text string")
    docs = read_table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return RT.sentence_chunks(base.unionByName(spread(docs)))


INDEX_SETTING = "kestrel.postings."


def write_text_index(spark, sf_dir, path: str) -> None:
    """The index step: write the postings of all chunks to ``path`` (the caller's, who also removes it) and let this
    session's queries over ``sf_dir`` read them.  After a change of the sources, write it anew."""
    PO.build(all_chunks(spark, sf_dir)).save(path)
    spark.conf.set(INDEX_SETTING + sf_dir, path)


def key_topk(spark, sf_dir):
    path = spark.conf.get(INDEX_SETTING + sf_dir, None)
    index = PO.load(spark, path) if path else PO.build(all_chunks(spark, sf_dir))
    return PO.search(index, QUERIES_OF_KEY).withColumnRenamed("doc_id", "cand_doc")


def _key_sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    base = ", ".join(f"({quote(c)}, {quote(t)})" for c, _, _, t in KB.chunks())
    asked = ", ".join(f"({i}, {quote(q)})" for i, q in QUERIES_OF_KEY)
    key = ", ".join(f"({i}, {quote(d)})" for i, (_, ds) in enumerate(KB.ANSWER_KEY) for d in ds)
    return f"""{_CHUNK_CTE},
every AS (SELECT row_number() OVER () AS key, * FROM (SELECT chunk_id, text FROM chunks UNION SELECT * FROM (VALUES {base}) v(chunk_id, text))),
ct AS (SELECT key, chunk_id, term, count(*)::DOUBLE AS tf FROM (SELECT key, chunk_id, {term_sql('text')} AS term FROM every) GROUP BY key, chunk_id, term),
cn AS (SELECT key, sqrt(sum(tf * tf)) AS norm FROM ct GROUP BY key),
asked AS (SELECT CAST(query_id AS BIGINT) AS query_id, text FROM (VALUES {asked}) v(query_id, text)),
rel AS (SELECT CAST(query_id AS BIGINT) AS query_id, doc_id FROM (VALUES {key}) v(query_id, doc_id)),
qt AS (SELECT query_id, term, count(*)::DOUBLE AS tf FROM (SELECT query_id, {term_sql('text')} AS term FROM asked) GROUP BY query_id, term),
fr AS (SELECT term, count(*) AS df FROM ct WHERE term IN (SELECT term FROM qt) GROUP BY term),
qw AS (SELECT query_id, qt.term, tf * (ln((1 + (SELECT count(*) FROM cn))::DOUBLE / (1 + coalesce(df, 0))) + 1) AS w FROM qt LEFT JOIN fr ON fr.term = qt.term),
qn AS (SELECT query_id, sqrt(sum(w * w)) AS n FROM qw GROUP BY query_id),
sc AS (SELECT qw.query_id, ct.key, ct.chunk_id, round(sum(w / n * tf / norm), 9) AS score
       FROM ct JOIN qw ON qw.term = ct.term JOIN qn ON qn.query_id = qw.query_id JOIN cn ON cn.key = ct.key GROUP BY qw.query_id, ct.key, ct.chunk_id),
topk AS (SELECT *, regexp_extract(chunk_id, '^(.*)-[0-9]+$', 1) AS doc_id FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sc) WHERE rank <= {RT.TOP_K}),
docs AS (SELECT DISTINCT query_id, doc_id FROM topk),
per AS (SELECT a.query_id, count(d.doc_id) AS n_retrieved, count(r.doc_id) AS n_hits,
          (SELECT count(*) FROM rel x WHERE x.query_id = a.query_id) AS n_relevant
        FROM asked a LEFT JOIN docs d ON d.query_id = a.query_id LEFT JOIN rel r ON r.query_id = d.query_id AND r.doc_id = d.doc_id GROUP BY a.query_id),
pr AS (
  SELECT query_id, n_retrieved, n_hits, CAST(n_relevant AS BIGINT) AS n_relevant,
         round(CASE WHEN n_retrieved = 0 THEN 0.0 ELSE CAST(n_hits AS DOUBLE) / n_retrieved END, 4) AS precision_at_k,
         round(CASE WHEN n_relevant = 0 THEN 0.0 ELSE CAST(n_hits AS DOUBLE) / n_relevant END, 4) AS recall_at_k
  FROM per)"""


@register("answer_key_topk", f"WITH {_key_sql()} SELECT query_id, rank, chunk_id, doc_id, round(score, 4) AS score FROM topk")
def q_answer_key_topk(spark, sf_dir):
    return key_topk(spark, sf_dir).select("query_id", "rank", "chunk_id", F.col("cand_doc").alias("doc_id"), F.round("score", 4).alias("score"))


def _per_query(spark, sf_dir):
    asked = spark.createDataFrame(QUERIES_OF_KEY, "query_id long, text string")
    relevant = spark.createDataFrame([(i, d) for i, (_, ds) in enumerate(KB.ANSWER_KEY) for d in ds], "query_id long, doc_id string")
    return RT.precision_recall(asked, key_topk(spark, sf_dir), relevant)


@register("retrieval_precision_recall", f"WITH {_key_sql()} SELECT * FROM pr")
def q_retrieval_pr(spark, sf_dir):
    return _per_query(spark, sf_dir)


@register("retrieval_macro_avg", f"WITH {_key_sql()} SELECT count(*) AS n_queries, "
          "((2 * sum(CAST(round(precision_at_k * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_precision_at_k, "
          "((2 * sum(CAST(round(recall_at_k * 10000) AS BIGINT)) + count(*)) // (2 * count(*))) / 10000.0 AS avg_recall_at_k FROM pr")
def q_retrieval_macro(spark, sf_dir):
    return RT.macro_average(_per_query(spark, sf_dir))


@register("chunk_text_embedding", f"WITH {_CHUNK_CTE}, t AS (SELECT chunk_id, doc_id, term, count(*)::DOUBLE AS tf FROM ("
          f"SELECT chunk_id, doc_id, {term_sql('text')} AS term FROM chunks) GROUP BY chunk_id, doc_id, term) "
          "SELECT chunk_id, doc_id, count(*) AS n_terms, CAST(sum(tf) AS BIGINT) AS n_tokens, round(sqrt(sum(tf * tf)), 6) AS norm FROM t GROUP BY chunk_id, doc_id")
def q_chunk_text_embedding(spark, sf_dir):
    """R3 on raw text: the sparse term vector of every chunk (its terms, tokens and length before it is brought to unit length)."""
    docs = spread(read_table(spark, sf_dir, "documents", ["doc_id", "text"]))
    vectors = RT.term_vectors(RT.sentence_chunks(docs), ["chunk_id", "doc_id"]).where(F.size("terms") > 0)
    return vectors.groupBy("chunk_id", "doc_id").agg(F.sum(F.size("terms")).alias("n_terms"), F.sum("tokens").alias("n_tokens"),
                                                   F.round(F.max("norm"), 6).alias("norm"))
