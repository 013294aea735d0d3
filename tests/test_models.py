"""Fitted-model invariants: quality floors, the saved artefact, the grid, importances, permutation, vector head."""
import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from kestrel.operators import models as M
from kestrel.operators import prep as P
from kestrel.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES
from kestrel.plans import models_plans as MP
from conftest import SF01


@pytest.fixture(scope="module")
def artefact(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("model"))
    MP.write_risk_model(spark, SF01, path)
    yield path
    spark.conf.unset(MP.MODEL_SETTING + SF01)


def test_logistic_floors(spark):
    r = queries()["logreg_eval"](spark, SF01).first()
    assert r.roc_auc >= 0.58 and r.f1 >= 0.30  # the reference's written acceptance floors


def test_grid(spark, artefact):
    rows = queries()["forest_cv"](spark, SF01).collect()
    assert {(r.num_trees, r.max_depth) for r in rows} == {(n, d) for n in (100, 200) for d in (6, 10, 30)}
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].cv_roc_auc == max(r.cv_roc_auc for r in rows)
    assert best[0].test_roc_auc >= 0.58 and best[0].cv_test_gap_ok


def test_artefact_scores_raw_rows(spark, artefact):
    model, meta = MP.risk_model(spark, SF01)
    assert meta["model_type"] == "RandomForestClassifier" and 0.1 <= meta["t_star_rf"] <= 0.9 and len(meta["slots"]) == 18
    assert meta["feature_columns"] == NUMERIC_FEATURES + CATEGORICAL_FEATURES
    row = spark.createDataFrame([(1800.0, 35.0, 40, 1, 0, 220.0, 6, 1, None, "Apparel", "COD"), (None,) * 9 + ("Unseen", None)],
                                "price_inr double, discount_pct double, customer_tenure_days int, num_previous_orders int, num_previous_returns int, "
                                "delivery_distance_km double, delivery_days int, is_weekend_order int, rating_given double, product_category string, payment_method string")
    assert all(0 <= r.score <= 1 for r in M.positive_score(model.transform(row)).collect())
    scored = queries()["risk_model_scores"](spark, SF01)
    assert scored.count() == spark.read.parquet(f"{SF01}/orders.parquet").count()
    t = meta["t_star_rf"]
    assert scored.where((F.col("t_star") != t) | ((F.col("risk_flag") == "HIGH") != (F.col("risk_bucket") != "Low"))).count() == 0


def test_importances_of_the_tuned_forest(spark, artefact):
    imp = queries()["impurity_importance"](spark, SF01)
    assert imp.count() == 18 and imp.where("top5").count() == 5
    assert abs(imp.agg(F.sum("importance")).first()[0] - 1.0) < 1e-9


def test_report(spark, artefact):
    r = queries()["model_report"](spark, SF01).first()
    assert set(r.asDict()) == {"baseline", "logistic", "forest", "importances", "subgroups", "vectors"}
    assert len(r.importances) == 5 and len(r.subgroups) == 9 and 0 <= r.vectors.test_accuracy <= 1


def test_unused_columns_have_zero_permutation_importance(spark):
    pi = {r.feature: r for r in queries()["permutation_importance"](spark, SF01).collect()}
    assert len(pi) == 11
    assert pi["rating_given"].perm_importance_mean == 0.0
    assert pi["delivery_distance_km"].perm_importance_mean == 0.0
    assert max(pi, key=lambda k: pi[k].perm_importance_mean) == "payment_method"


def test_head(spark):
    rows = queries()["linear_head"](spark, SF01).collect()
    assert [r.iterations for r in rows if r.stage == "head"] == list(MP.ITERATIONS)
    best = [r for r in rows if r.best]
    assert len(best) == 1 and best[0].val_accuracy == max(r.val_accuracy for r in rows) and best[0].test_accuracy is not None
    fired = max(r.val_accuracy for r in rows if r.stage == "head") < MP.GATE
    assert rows[0].gate_fired == fired and any(r.stage == "refit" for r in rows) == fired
    per = queries()["linear_head_report"](spark, SF01).collect()
    train, val, test = MP.head_split(spark, SF01)
    ids = [{r.vec_id for r in d.select("vec_id").collect()} for d in (train, val, test)]
    assert not ids[0] & ids[1] and not ids[0] & ids[2] and not ids[1] & ids[2]
    assert sum(map(len, ids)) == spark.read.parquet(f"{SF01}/embeddings.parquet").count()
    assert sum(r.support for r in per) == len(ids[2]) and len(per) == 10


def test_head_refit_when_the_gate_fires(spark, monkeypatch):
    monkeypatch.setattr(MP, "GATE", 1.1)
    monkeypatch.setattr(MP, "ITERATIONS", (1, 2))
    assert [r.stage for r in MP.q_linear_head(spark, SF01).collect()] == ["head"] * 2 + ["refit"] * len(MP.WIDER)


def test_missing_model_has_clear_error(spark, tmp_path):
    from pyspark.ml.classification import LogisticRegressionModel

    with pytest.raises(FileNotFoundError, match="no saved model"):
        M.load_model(str(tmp_path / "absent"), LogisticRegressionModel)


def test_a_save_that_stops_leaves_the_older_version(spark, tmp_path, monkeypatch):
    import glob
    import os

    from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
    from pyspark.ml.linalg import VectorUDT, Vectors
    from pyspark.sql.types import IntegerType, StructField, StructType

    df = spark.createDataFrame([(Vectors.dense([float(i)]), i % 2) for i in range(10)], StructType([StructField("features", VectorUDT()), StructField("y", IntegerType())]))
    path = str(tmp_path / "model")
    first = LogisticRegression(labelCol="y", maxIter=1).fit(df)
    M.save_model(first, {"v": 1}, path)
    monkeypatch.setattr(M, "_publish", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
    with pytest.raises(OSError, match="stopped"):
        M.save_model(LogisticRegression(labelCol="y", maxIter=20).fit(df), {"v": 2}, path)
    monkeypatch.undo()
    model, meta = M.load_model(path, LogisticRegressionModel)
    assert meta == {"v": 1} and model.intercept == first.intercept
    M.save_model(LogisticRegression(labelCol="y", maxIter=20).fit(df), {"v": 3}, path)
    assert M.load_model(path, LogisticRegressionModel)[1] == {"v": 3}
    newest = sorted(glob.glob(f"{path}/versions/v000002-*/meta/part-*"))
    for name in newest:  # the published one and the one that stopped share the number
        with open(name, "w") as f:
            f.write("{}")
        for crc in glob.glob(name.replace("part-", ".part-") + ".crc"):
            os.remove(crc)
    with pytest.raises(ValueError, match="published"):
        M.load_model(path, LogisticRegressionModel)


def test_medians_of_tied_columns_over_the_boundary(spark):
    n = 2 * P.BOUNDARY_ROWS + 4000
    for rows in (n, n + 1):
        df = spark.range(rows).selectExpr(f"cast(id >= {n // 2} as int) half", f"cast(id >= {n // 2} - 20 as int) near", f"case when id < {n // 2} - 1 then 3 when id < {n // 2} + 1 then 4 else 7 end step",
                                          f"case when id < {n // 2} - 7 then 0D when id < {n // 2} + 9 then id / 1e6 else 1D end inner", f"case when id < {n // 2} then 0 when id < {n // 2} + 5 then 1 else 2 end beside",
                                          f"case when id < {n // 2} - 5 then 0 when id < {n // 2} then 1 else 2 end before", f"if(id % 7 = 0, null, cast(id >= {n // 2} as int)) nulls", "id % 2 mixed").repartition(3)
        want = df.toPandas().median()
        got = P.exact_medians(df, df.columns)
        assert got == {c: float(want[c]) for c in df.columns}


def test_medians_and_cuts_narrow_down(spark, monkeypatch):
    monkeypatch.setattr(P, "BOUNDARY_ROWS", 30)
    df = spark.range(5001).selectExpr("id", "id % 3 as label", "cast((id * 7919) % 5003 as double) a", "case when id % 4 = 0 then null else cast(id % 10 as double) end b",
                                      "cast(null as double) c", "1.5 d").repartition(4)
    rows = df.toPandas()
    got = P.exact_medians(df, ["a", "b", "c", "d"])
    assert got["a"] == rows.a.median() and got["b"] == rows.b.median() and got["c"] is None and got["d"] == 1.5
    split = P.stratified_split(df, "label", "id", 0.2)
    counts = {(r.label, r.split): r["count"] for r in split.groupBy("label", "split").count().collect()}
    assert sum(v for (_, s), v in counts.items() if s == "test") == 1001
    assert all(abs(counts[k, "test"] - 1667 * 0.2) <= 1 for k in range(3))
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan.replace("Exchange RoundRobin", "").replace("Exchange REPARTITION", "").replace("RoundRobinPartitioning(4), REPARTITION_BY_NUM", "") or plan.count("Exchange") == 1


def test_folds(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 as label")
    for rows in (50_000, 100):
        folds = P.kfold_assign(df, "label", "id", 5, rows_per_bucket=rows)
        counts = [r["count"] for r in folds.groupBy("label", "fold").count().collect()]
        assert len(counts) == 10 and set(counts) == {300}
    a = P.kfold_assign(df, "label", "id", 5).collect()
    b = P.kfold_assign(df, "label", "id", 5, rows_per_bucket=100).collect()
    assert sorted(a) == sorted(b)


def test_sample_is_bounded(spark):
    df = spark.range(3000).selectExpr("id", "id % 2 as label")
    assert M.bounded_sample(df, "label", "id", 100).count() == 100
    assert M.bounded_sample(df, "label", "id", 5000).count() == 3000


def test_unknown_label_is_an_error(spark):
    from kestrel.operators import messages as MS

    v = spark.read.parquet(f"{SF01}/embeddings.parquet").withColumn("label", F.when(F.col("vec_id") == 3, 11).otherwise(F.col("label")))
    with pytest.raises(Exception, match="unknown label"):
        MS.class_centroids(v)


def test_vector_table_sink(spark, tmp_path):
    from kestrel.sources.sinks import write_vector_table

    v = spark.read.parquet(f"{SF01}/embeddings.parquet")
    write_vector_table(v, str(tmp_path / "vt"))
    back = spark.read.parquet(str(tmp_path / "vt"))
    norms = back.select(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("n"))
    assert norms.agg(F.max(F.abs(F.col("n") - 1.0))).first()[0] < 1e-6
