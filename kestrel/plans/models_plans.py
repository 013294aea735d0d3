"""Fitted-model queries (M2-M9, E6, E7, E9-E13 on the fitted head, S4-S6).

``risk_model`` is the one return-risk artefact: preparation and tuned forest in one pipeline, with its threshold on
the test split in the metadata.  ``write_risk_model`` trains and saves it at a path of the caller's and lets this
session's queries use it; without that step a query trains its own.
"""
from __future__ import annotations

import uuid

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kestrel.functions import rules as R
from kestrel.functions import text_rules as T
from kestrel.operators import evaluate as E
from kestrel.operators import models as M
from kestrel.operators import multiclass as MC
from kestrel.operators import prep as P
from kestrel.operators import risk
from kestrel.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from kestrel.plans.oracle_orders import with_orders, z_sql
from kestrel.plans.prep_plans import split_orders, split_sql
from kestrel.plans.registry import register
from kestrel.session import ensure_checkpoint_dir, materialise, stored
from kestrel.sources import sinks
from kestrel.sources.tables import read_table

RAW = NUMERIC_FEATURES + CATEGORICAL_FEATURES
MODEL_SETTING = "kestrel.riskModel."  # + input folder: where the caller has saved its model


def _orders(spark, sf_dir):
    """Every order's model columns and split, written once for a query: what it fits, scores and evaluates reads this."""
    return split_orders(spark, sf_dir, ["order_id", "returned", *RAW])


def _parts(orders):
    return orders.where("split = 'train'").drop("split"), orders.where("split = 'test'").drop("split")


def _evaluated(scored):
    """Metrics of (label, score) rows as plain numbers."""
    m = E.binary_metrics(scored, "label", "score", 0.5).first()
    best = E.best_threshold(E.threshold_sweep(scored, "label", "score")).first()
    out = {k: round(m[k], 4) for k in ("accuracy", "precision", "recall", "f1")}
    return out | {"n": m["n"], "roc_auc": round(E.roc_auc(scored, "label", "score").first()["roc_auc"], 4),
                  "best_threshold": best["threshold"], "best_f1": round(best["f1"], 4), "best_recall": round(best["recall"], 4)}


def _scored(model, rows):
    return M.positive_score(model.transform(rows)).select(F.col("returned").alias("label"), "score", *CATEGORICAL_FEATURES)


def _prepared(orders):
    return M.Prepared(_parts(orders)[0], NUMERIC_FEATURES, CATEGORICAL_FEATURES)


def _fit_logistic(orders, prep=None):
    train, test = _parts(orders)
    prep = prep or _prepared(orders)
    model = M.fit_logistic(stored(prep.apply(train).select("returned", "features"), "prepared"), "returned")
    return PipelineModel(stages=[*prep.stages, model]), test


@register("logreg_eval")
def q_logreg_eval(spark, sf_dir):
    """M2 scored on the test split: metrics at 0.5, ROC-AUC and the best sweep threshold."""
    model, test = _fit_logistic(_orders(spark, sf_dir))
    m = _evaluated(stored(_scored(model, test), "scored"))
    cols = ["n", "accuracy", "precision", "recall", "f1", "roc_auc", "best_threshold", "best_f1"]
    return spark.createDataFrame([tuple(m[c] for c in cols)], "n long, " + ", ".join(f"{c} double" for c in cols[1:]))


def train_risk_model(spark, sf_dir, orders=None, prep=None):
    """M3-M5: prepare on the train split, search the grid on all of it, refit the best point on all of it, evaluate on test.

    Returns (pipeline model, metadata).  ``orders`` and ``prep``: what the query holds of them already."""
    orders = _orders(spark, sf_dir) if orders is None else orders
    train, test = _parts(orders)
    prep = prep or _prepared(orders)
    rows = stored(prep.apply(train).select("order_id", "returned", "features"), "prepared")
    forest, results, fit_rows = M.forest_grid_search(P.kfold_assign(rows, "returned", "order_id", 5), "returned", "order_id")
    best = max(results, key=lambda r: r["cv_roc_auc"])
    model = PipelineModel(stages=[*prep.stages, forest])
    scored = _evaluated(stored(_scored(model, test), "scored"))
    meta = {"t_star_rf": scored["best_threshold"], "feature_columns": RAW, "model_type": "RandomForestClassifier",
            "best_params": {"num_trees": best["num_trees"], "max_depth": best["max_depth"]}, "test_roc_auc": scored["roc_auc"],
            "cv": results, "slots": prep.slot_names, "fit_rows": fit_rows, "test": scored}
    return model, meta


def write_risk_model(spark, sf_dir, path: str) -> None:
    """The training step: save the artefact at ``path`` and let this session's queries over ``sf_dir`` load it."""
    M.save_model(*train_risk_model(spark, sf_dir), path)
    spark.conf.set(MODEL_SETTING + sf_dir, path)


def risk_model(spark, sf_dir, orders=None, prep=None):
    """The artefact as it was saved: always loaded anew, so that it scores from its files alone."""
    path = spark.conf.get(MODEL_SETTING + sf_dir, None)
    if not path:
        path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
        M.save_model(*train_risk_model(spark, sf_dir, orders, prep), path)
    return M.load_model(path, PipelineModel)


@register("forest_cv")
def q_forest_cv(spark, sf_dir):
    """M3 + M4 + M5: 2x3 grid, 5 stratified folds, ROC-AUC; best row, its test AUC and the gap."""
    _, meta = risk_model(spark, sf_dir)
    auc, best = meta["test_roc_auc"], max(meta["cv"], key=lambda r: r["cv_roc_auc"])
    rows = [(r["num_trees"], r["max_depth"], round(r["cv_roc_auc"], 4), r is best, auc if r is best else None,
             (abs(r["cv_roc_auc"] - auc) < 0.05) if r is best else None) for r in meta["cv"]]
    return spark.createDataFrame(rows, "num_trees int, max_depth int, cv_roc_auc double, best boolean, "
                                       "test_roc_auc double, cv_test_gap_ok boolean")


@register("impurity_importance")
def q_impurity_importance(spark, sf_dir):
    """Impurity importances of the tuned forest by slot; the first five are marked."""
    model, meta = risk_model(spark, sf_dir)
    rows = sorted(zip(meta["slots"], model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
    return spark.createDataFrame([(f, v, i < 5) for i, (f, v) in enumerate(rows)], "feature string, importance double, top5 boolean")


@register("risk_model_scores")
def q_risk_model_scores(spark, sf_dir):
    """M6, B1, B2 with the loaded artefact: every order's probability, bucket and flag at the model's own threshold."""
    orders = _orders(spark, sf_dir)
    model, meta = risk_model(spark, sf_dir, orders)
    scored = M.positive_score(model.transform(orders.select("order_id", *meta["feature_columns"])))
    out = risk.risk_flag(risk.risk_bucket(scored, "score", meta["t_star_rf"]), "score", meta["t_star_rf"])
    return out.select("order_id", "return_probability", "risk_bucket", "risk_flag", "t_star", "low_below", "high_at_or_above")


def _closed_form(c: dict):
    """The closed-form score of a dict of feature columns."""
    ratio = R.safe_div(c["num_previous_returns"], c["num_previous_orders"])
    return R.logistic_score(ratio, c["product_category"], c["discount_pct"], c["payment_method"], c["delivery_days"],
                            c["price_inr"], c["is_weekend_order"], c["customer_tenure_days"])


PERM_BUCKETS = 16


def _perm_sql(n_repeats: int = 20) -> str:
    from kestrel.functions.hashing import TWO_POW_32, uniform_sql

    vals = ", ".join(f"('{c}')" for c in RAW)
    repl = ", ".join(f"CASE WHEN k.c = '{c}' THEN d_{c} ELSE {c} END AS {c}" for c in RAW)
    lead = ", ".join(f"CASE WHEN lead(order_id) OVER w IS NULL THEN first({c}) OVER whole ELSE lead({c}) OVER w END AS d_{c}" for c in RAW)
    key = "CAST(order_id AS VARCHAR) || '|' || CAST(r AS VARCHAR)"
    ratio = ("CASE WHEN num_previous_orders = 0 THEN 0.0 "
             "ELSE CAST(num_previous_returns AS DOUBLE) / num_previous_orders END AS prev_return_ratio")
    auc = lambda src, by: f"""(SELECT {by} score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos,
                 sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM {src} GROUP BY {by} score)"""  # noqa: E731
    body = f""", rows0 AS (SELECT t.*, r, CAST({uniform_sql(key, 'perm')} * {TWO_POW_32} AS BIGINT) AS h FROM test t, range(0, {n_repeats}) rr(r)),
rows1 AS (SELECT *, h % {PERM_BUCKETS} AS part FROM rows0),
donated AS (SELECT *, {lead} FROM rows1
            WINDOW w AS (PARTITION BY r, part ORDER BY h, order_id),
                   whole AS (PARTITION BY r, part ORDER BY h, order_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
perm0 AS (SELECT k.c, d.r, d.returned AS label, {repl} FROM donated d, (VALUES {vals}) k(c)),
perm1 AS (SELECT *, {ratio} FROM perm0),
perm AS (SELECT c, r, label, 1.0 / (1.0 + exp(-({z_sql()}))) AS score FROM perm1),
ref1 AS (SELECT returned AS label, * EXCLUDE (prev_return_ratio), {ratio} FROM test),
ref AS (SELECT label, 1.0 / (1.0 + exp(-({z_sql()}))) AS score FROM ref1),
pa AS {auc('perm', 'c, r,')},
pc AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY c, r ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM pa),
pauc AS (SELECT c, r, sum(CAST(2 * nb + neg AS DOUBLE) * pos) / (2.0 * sum(pos) * sum(neg)) AS auc FROM pc GROUP BY c, r),
ra AS {auc('ref', '')},
rc AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM ra),
rauc AS (SELECT sum(CAST(2 * nb + neg AS DOUBLE) * pos) / (2.0 * sum(pos) * sum(neg)) AS ref_auc FROM rc)
SELECT c AS feature, round(avg(ref_auc - auc), 6) AS perm_importance_mean,
       round(stddev_pop(ref_auc - auc), 6) AS perm_importance_std FROM pauc, rauc GROUP BY c"""
    return with_orders(split_sql() + body)


@register("permutation_importance", _perm_sql())
def q_permutation_importance(spark, sf_dir):
    """E7 on the test split with the closed-form scorer: 11 raw columns x 20 shuffles."""
    _, test = _parts(_orders(spark, sf_dir))
    pi = M.permutation_importance(test, "order_id", "returned", RAW, _closed_form, n_repeats=20, buckets=PERM_BUCKETS)
    return pi.select("feature", F.round("perm_importance_mean", 6).alias("perm_importance_mean"),
                     F.round("perm_importance_std", 6).alias("perm_importance_std"))


@register("model_roundtrip", with_orders("q AS (SELECT 1) SELECT count(*) AS n_scored, CAST(0 AS DOUBLE) AS max_abs_diff, "
          f"count(*) AS n_in_range, CAST({len(NUMERIC_FEATURES) + 9} AS INTEGER) AS n_slots, CAST({len(RAW)} AS INTEGER) AS n_columns FROM order_features"))
def q_model_roundtrip(spark, sf_dir):
    """S5 + S6 + M6: save preparation and model as one artefact, load it, score every raw order with both in one pass."""
    orders = _orders(spark, sf_dir)
    model, _ = _fit_logistic(orders)
    path = f"{ensure_checkpoint_dir(spark)}/model-{uuid.uuid4().hex}"
    prep_slots = len(NUMERIC_FEATURES) + sum(len(s.labels) for s in model.stages[1:1 + len(CATEGORICAL_FEATURES)])
    M.save_model(model, {"feature_columns": RAW, "model_type": "LogisticRegression", "n_slots": prep_slots}, path)
    loaded, meta = M.load_model(path, PipelineModel)
    rows = orders.select("order_id", *meta["feature_columns"])
    rows = M.positive_score(model.transform(rows), "s1").select(*rows.columns, "s1")
    rows = M.positive_score(loaded.transform(rows), "s2").select("s1", "s2")
    return rows.agg(F.count(F.lit(1)).alias("n_scored"), F.max(F.abs(F.col("s1") - F.col("s2"))).alias("max_abs_diff"),
                    F.sum(F.col("s2").between(0.0, 1.0).cast("long")).alias("n_in_range"),
                    F.lit(meta["n_slots"]).alias("n_slots"), F.lit(len(meta["feature_columns"])).alias("n_columns"))


# ------------------------------------------------------------------ vector classifier
ITERATIONS = (1, 2, 3, 5, 8, 13, 20)
GATE = 0.80
WIDER = (0.0, 0.001, 0.01, 0.1)


def head_split(spark, sf_dir):
    """Train, validation and test vectors, each stratified by label."""
    v = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"]).withColumn("features", array_to_vector("embedding"))
    rest = P.stratified_split(v, "label", "vec_id", 0.2, names=("rest", "test"))
    test = rest.where("split = 'test'").drop("split")
    rest = P.stratified_split(rest.where("split = 'rest'").drop("split"), "label", "vec_id", 0.2, names=("train", "val"), tag="val")
    return rest.where("split = 'train'"), rest.where("split = 'val'"), test


def _predicted(model, rows):
    return model.transform(rows).select("vec_id", F.col("label").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))


def fit_head(spark, sf_dir):
    """M7 + M8: the linear head after each of ITERATIONS steps with its validation accuracy; if the best stays under the
    gate, a refit over a wider range of regularisation.  Returns (best model, log rows, test rows)."""
    train, val, test = head_split(spark, sf_dir)
    train, val = materialise(train.select("vec_id", "label", "features")), materialise(val.select("vec_id", "label", "features"))
    log, best = [], None

    def attempt(stage, steps, reg):
        nonlocal best
        model = LogisticRegression(featuresCol="features", labelCol="label", family="multinomial", maxIter=steps, regParam=reg).fit(train)
        acc = MC.accuracy(_predicted(model, val)).first()["accuracy"]
        log.append([stage, steps, reg, acc])
        if best is None or acc > best[0]:
            best = (acc, model, len(log) - 1)

    for steps in ITERATIONS:
        attempt("head", steps, 0.0)
    if best[0] < GATE:
        for reg in WIDER:
            attempt("refit", 100, reg)
    return best, log, test


@register("linear_head")
def q_linear_head(spark, sf_dir):
    """M7 + M8 + E9: validation accuracy by iteration, the best one, whether the gate fired, and the best one's test accuracy."""
    (acc, model, at), log, test = fit_head(spark, sf_dir)
    test_acc = MC.accuracy(_predicted(model, test)).first()["accuracy"]
    fired = any(r[0] == "refit" for r in log)
    rows = [(*r[:3], round(r[3], 4), i == at, fired, round(test_acc, 4) if i == at else None) for i, r in enumerate(log)]
    return spark.createDataFrame(rows, "stage string, iterations int, reg double, val_accuracy double, best boolean, gate_fired boolean, test_accuracy double")


@register("linear_head_report")
def q_linear_head_report(spark, sf_dir):
    """E10-E12 of the fitted head on its test split: per-class figures with the class's most frequent confusion."""
    (_, model, _), _, test = fit_head(spark, sf_dir)
    cm = MC.confusion_long(_predicted(model, test), len(T.CLASS_NAMES))
    worst = cm.where("y_true <> y_pred").groupBy(F.col("y_true").alias("label")).agg(F.max_by(F.struct("y_pred", "n"), F.struct("n", -F.col("y_pred"))).alias("w"))
    return MC.per_class(cm).join(worst, "label").select("label", "support", "precision", "recall", "f1", F.col("w.y_pred").alias("most_confused_with"), F.col("w.n").alias("n_confused"))


@register("model_report")
def q_model_report(spark, sf_dir):
    """The whole report as one nested JSON document, written by the sink and read back: baseline, logistic regression,
    forest with its grid, importances and subgroups, and the vector classifier."""
    orders = _orders(spark, sf_dir)
    train, test = _parts(orders)
    base = M.baseline_majority(train, test, "returned").first().asDict()
    prep = _prepared(orders)
    logistic, _ = _fit_logistic(orders, prep)
    forest, meta = risk_model(spark, sf_dir, orders, prep)
    importances = sorted(zip(meta["slots"], forest.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))[:5]
    groups = E.subgroup_metrics(stored(_scored(forest, test), "scored"), CATEGORICAL_FEATURES, "label", "score", 0.5).collect()  # a row for each group
    (acc, head, _), _, vectors = fit_head(spark, sf_dir)
    report = {
        "baseline": base, "logistic": _evaluated(stored(_scored(logistic, test), "scored")), "forest": {**meta["best_params"], **meta["test"]},
        "importances": [{"feature": f, "importance": v} for f, v in importances], "subgroups": [r.asDict() for r in groups],
        "vectors": {"val_accuracy": acc, "test_accuracy": MC.accuracy(_predicted(head, vectors)).first()["accuracy"]}}
    import json

    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    parsed = spark.createDataFrame([(json.dumps(report),)], "j string")
    schema = parsed.select(F.schema_of_json(F.lit(json.dumps(report)))).first()[0]
    sinks.write_report_json(parsed.select(F.from_json("j", schema).alias("r")).select("r.*"), path)
    return spark.read.json(path).select(sorted(report))


def _slots_sql() -> str:
    nums = ", ".join(f"({i}, '{c}')" for i, c in enumerate(NUMERIC_FEATURES))
    cats = " UNION ALL ".join(
        f"SELECT '{c}_' || v AS feature, {g} AS grp, v FROM (SELECT DISTINCT {c} AS v FROM train)"
        for g, c in enumerate(CATEGORICAL_FEATURES))
    return with_orders(split_sql() + f""", num AS (SELECT CAST(slot AS INTEGER) AS slot, feature FROM (VALUES {nums}) t(slot, feature)),
cats AS ({cats}),
catslots AS (SELECT CAST({len(NUMERIC_FEATURES)} + row_number() OVER (ORDER BY grp, v) - 1 AS INTEGER) AS slot, feature FROM cats)
SELECT slot, feature FROM num UNION ALL SELECT slot, feature FROM catslots""")


@register("feature_slots", _slots_sql())
def q_feature_slots(spark, sf_dir):
    """The assembled vector's slot names in order (numeric, then one-hot per category)."""
    prep = _prepared(_orders(spark, sf_dir))
    return spark.createDataFrame(list(enumerate(prep.slot_names)), "slot int, feature string")
