"""Exact top-k against brute force; chunking and term counts."""
import numpy as np
from pyspark.sql import functions as F

from kestrel.operators import retrieval as RT
from conftest import SF01


def _vectors(spark):
    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    q = v.where("vec_id % 7 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    c = v.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("doc"), "embedding")
    return v, q, c


def test_topk_equals_brute_force(spark):
    v, q, c = _vectors(spark)
    twice = c.unionByName(c.withColumn("id", F.col("id") + 10000))  # every score is met twice
    got = sorted((r.query_id, r.rank, r.cand_id, round(r.score, 9)) for r in RT.topk_inner_product(q, twice, 3, exclude_self=True).collect())
    pdf = v.toPandas()
    m = np.stack(pdf.embedding.to_numpy()).astype(np.float64)
    ids = pdf.vec_id.to_numpy()
    every, both = np.concatenate([ids, ids + 10000]), np.vstack([m, m])
    want = []
    for i, qid in enumerate(ids):
        if qid % 7:
            continue
        s = both @ m[i]
        order = sorted((j for j in range(len(every)) if every[j] != qid), key=lambda j: (-round(s[j], 12), every[j]))[:3]
        want += [(int(qid), r + 1, int(every[j]), round(float(s[j]), 9)) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_fewer_than_k(spark):
    _, q, c = _vectors(spark)
    out = RT.topk_inner_product(q.limit(5), c.limit(2), 3)
    assert out.groupBy("query_id").count().agg(F.max("count")).first()[0] == 2


def test_sentence_split_edges(spark):
    docs = spark.createDataFrame([
        (1, "One sentence only."),
        (2, "Returns within 10-15 days. Refund follows! Is it fast? yes it is."),
        (3, "Dr. Smith said so. Études follow no split."),
        (4, "   "),
        (5, "A no-break space.\u00a0Then one more. "),
    ], "doc_id long, text string")
    got = {r.chunk_id: r.text for r in RT.sentence_chunks(docs).collect()}
    assert got == {
        "1-00": "One sentence only.",
        "2-00": "Returns within 10-15 days.",
        "2-01": "Refund follows!",
        "2-02": "Is it fast? yes it is.",
        "3-00": "Dr.",
        "3-01": "Smith said so. Études follow no split.",
        "5-00": "A no-break space.",
        "5-01": "Then one more.",
    }


def test_term_counts(spark):
    df = spark.createDataFrame([(1, "To be, or not TO be: été 2"), (1, "x"), (2, ""), (3, None)], "k long, text string")
    got = sorted((r.k, r.term, r.tf, round(r.norm, 6)) for r in RT.term_counts(df, ["k"]).collect())
    n = round(12 ** 0.5, 6)
    assert got == [(1, "2", 1.0, n), (1, "be", 2.0, n), (1, "not", 1.0, n), (1, "or", 1.0, n), (1, "to", 2.0, n), (1, "x", 1.0, 1.0), (1, "été", 1.0, n)]
