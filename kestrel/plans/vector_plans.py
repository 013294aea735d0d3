"""Vector classification queries over ``embeddings``.

The classifier is a nearest-centroid softmax scorer fitted on the train split (class mean
vectors): deterministic, so its evaluation is checked against DuckDB.  The fitted linear
head (M7) is in ``models_plans``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.functions import text_rules as T
from kestrel.functions.hashing import uniform_sql
from kestrel.operators import messages as MS
from kestrel.operators import multiclass as MC
from kestrel.operators import prep as P
from kestrel.plans.registry import register
from kestrel.sources.tables import read_table

VAL_FRACTION = 0.2
ABS_VAL_SIZE = 100
QUALITY_GATE = 0.80


def split_vectors(spark, sf_dir, test_size=VAL_FRACTION) -> DataFrame:
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return P.stratified_split(v, "label", "vec_id", test_size, names=("train", "val"))


def centroid_predictions(spark, sf_dir) -> DataFrame:
    s = split_vectors(spark, sf_dir)
    cents = MS.class_centroids(s.where("split = 'train'"))
    return MS.softmax_classify(s, cents)


def val_predictions(spark, sf_dir) -> DataFrame:
    return centroid_predictions(spark, sf_dir).where("split = 'val'").select(
        "vec_id", F.col("label").alias("y_true"), F.col("pred").alias("y_pred"), "confidence")


def _split_sql(nt_expr: str) -> str:
    return f"""cnt AS (SELECT label, count(*) AS n_c FROM embeddings GROUP BY label),
q0 AS (SELECT label, n_c, sum(n_c) OVER () AS n, {nt_expr} AS nt FROM cnt),
q1 AS (SELECT *, (nt * n_c) // n AS base, (nt * n_c) % n AS rem FROM q0),
q2 AS (SELECT *, nt - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label ASC) AS rk FROM q1),
quotas AS (SELECT label, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM q2),
ranked AS (SELECT e.*, row_number() OVER (PARTITION BY label ORDER BY {uniform_sql('vec_id', 'split')}, vec_id) - 1 AS pos
           FROM embeddings e),
vsplit AS (SELECT r.vec_id, r.label, r.embedding, CASE WHEN r.pos < q.quota THEN 'val' ELSE 'train' END AS split
           FROM ranked r JOIN quotas q USING (label))"""


_FRAC_SPLIT = _split_sql(f"CAST(ceil(round({VAL_FRACTION} * sum(n_c) OVER (), 9)) AS BIGINT)")

_PRED_SQL = _FRAC_SPLIT + f""",
elems AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM vsplit WHERE split = 'train'),
cent AS (SELECT label AS c, list(m ORDER BY pos) AS centroid FROM (
           SELECT label, pos, avg(CAST(x AS DOUBLE)) AS m FROM elems GROUP BY label, pos) GROUP BY label),
logits AS (SELECT v.vec_id, v.label, v.split, c.c, list_dot_product(CAST(v.embedding AS DOUBLE[]), c.centroid) AS l
           FROM vsplit v JOIN cent c ON true),
mx AS (SELECT vec_id, max(l) AS lmax FROM logits GROUP BY vec_id),
preds AS (
  SELECT g.vec_id, g.label, g.split,
         CAST(min(CASE WHEN g.l = m.lmax THEN g.c END) AS INTEGER) AS pred,
         round(1.0 / sum(exp(g.l - m.lmax)), 4) AS confidence
  FROM logits g JOIN mx m USING (vec_id) GROUP BY g.vec_id, g.label, g.split),
val AS (SELECT vec_id, label AS y_true, pred AS y_pred FROM preds WHERE split = 'val'),
grid AS (SELECT CAST(i // 10 AS INTEGER) AS y_true, CAST(i % 10 AS INTEGER) AS y_pred FROM range(0, 100) r(i)),
cm AS (SELECT g.y_true, g.y_pred, count(v.vec_id) AS n FROM grid g LEFT JOIN val v ON v.y_true = g.y_true AND v.y_pred = g.y_pred
       GROUP BY g.y_true, g.y_pred)"""

_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in T.CLASS_NAMES) + "]"


@register("stratified_split_n", "WITH " + _split_sql(f"CAST({ABS_VAL_SIZE} AS BIGINT)") +
          " SELECT vec_id, label, split FROM vsplit")
def q_stratified_split_n(spark, sf_dir):
    return split_vectors(spark, sf_dir, ABS_VAL_SIZE).select("vec_id", "label", "split")


@register("vector_classify", "WITH " + _PRED_SQL + f" SELECT vec_id, pred, {_NAMES_SQL}[pred + 1] AS predicted_class, "
          "confidence FROM preds")
def q_vector_classify(spark, sf_dir):
    return centroid_predictions(spark, sf_dir).select("vec_id", "pred", "predicted_class", "confidence")


@register("multiclass_accuracy", "WITH " + _PRED_SQL + " SELECT count(*) AS n, "
          "round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM val")
def q_multiclass_accuracy(spark, sf_dir):
    return MC.accuracy(val_predictions(spark, sf_dir)).select("n", F.round("accuracy", 6).alias("accuracy"))


@register("quality_gate", "WITH " + _PRED_SQL + " SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 4) AS val_accuracy, "
          f"avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) < {QUALITY_GATE} AS fine_tuning_required FROM val")
def q_quality_gate(spark, sf_dir):
    a = MC.accuracy(val_predictions(spark, sf_dir))
    return a.select(F.round("accuracy", 4).alias("val_accuracy"), (F.col("accuracy") < QUALITY_GATE).alias("fine_tuning_required"))


@register("confusion_matrix", "WITH " + _PRED_SQL + " SELECT y_true, y_pred, n FROM cm")
def q_confusion_matrix(spark, sf_dir):
    return MC.confusion_long(val_predictions(spark, sf_dir), len(T.CLASS_NAMES))


@register("per_class_metrics", "WITH " + _PRED_SQL + """,
rs AS (SELECT y_true AS label, sum(n) AS support, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY y_true),
cs AS (SELECT y_pred AS label, sum(n) AS predicted FROM cm GROUP BY y_pred),
m AS (SELECT rs.label, CAST(rs.support AS BIGINT) AS support, rs.tp, cs.predicted FROM rs JOIN cs USING (label))
SELECT label, support,
  round(CASE WHEN predicted = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / predicted END, 4) AS precision,
  round(CASE WHEN support = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / support END, 4) AS recall,
  round(CASE WHEN predicted + support = 0 THEN 0.0 ELSE 2.0 * tp / (predicted + support) END, 4) AS f1
FROM m""")
def q_per_class_metrics(spark, sf_dir):
    return MC.per_class(MC.confusion_long(val_predictions(spark, sf_dir), len(T.CLASS_NAMES)))


@register("top_confused_pairs", "WITH " + _PRED_SQL + f" SELECT y_true, y_pred, {_NAMES_SQL}[y_true + 1] AS true_class, "
          f"{_NAMES_SQL}[y_pred + 1] AS predicted_class, n FROM cm WHERE y_true <> y_pred ORDER BY n DESC, y_true, y_pred LIMIT 5")
def q_top_confused_pairs(spark, sf_dir):
    return MC.top_confused(MC.confusion_long(val_predictions(spark, sf_dir), len(T.CLASS_NAMES)), T.CLASS_NAMES, 5)


@register("first_per_class", f"SELECT label, min(vec_id) AS vec_id, printf('%02d_%s.png', label, {_NAMES_SQL}[label + 1]) "
          "AS file_name FROM embeddings GROUP BY label")
def q_first_per_class(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "label"])
    return MC.first_per_class(v, "label", "vec_id", T.CLASS_NAMES)


@register("confusion_matrix_wide", "WITH " + _PRED_SQL + " SELECT " + _NAMES_SQL + "[y_true + 1] AS class, " + ", ".join(
    f"CAST(sum(CASE WHEN y_pred = {i} THEN n ELSE 0 END) AS BIGINT) AS {name}" for i, name in enumerate(T.CLASS_NAMES))
    + " FROM cm GROUP BY y_true")
def q_confusion_matrix_wide(spark, sf_dir):
    """E10 wide / S3: rows = true class (named), columns = predicted class; written as CSV by the sink and read back."""
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    wide = MC.confusion_wide(MC.confusion_long(val_predictions(spark, sf_dir), len(T.CLASS_NAMES)), T.CLASS_NAMES)
    path = f"{ensure_checkpoint_dir(spark)}/confusion-{uuid.uuid4().hex}"
    sinks.write_result_csv(wide, path)
    return spark.read.schema("class string, " + ", ".join(f"{n} long" for n in T.CLASS_NAMES)).option("header", True).csv(path)


@register("prediction_records", "WITH " + _PRED_SQL + f" SELECT g.vec_id, {_NAMES_SQL}[p.pred + 1] AS predicted_class, p.confidence, "
          f"{_NAMES_SQL}[g.c + 1] AS class, round(exp(g.l - m.lmax) / sum(exp(g.l - m.lmax)) OVER (PARTITION BY g.vec_id), 4) AS probability "
          "FROM logits g JOIN mx m USING (vec_id) JOIN preds p ON p.vec_id = g.vec_id")
def q_prediction_records(spark, sf_dir):
    """The prediction record of each vector, one row for each class probability."""
    return centroid_predictions(spark, sf_dir).select("vec_id", "predicted_class", "confidence", F.explode("all_probabilities").alias("class", "probability"))
