"""Forests over all rows: every row counts, grid points are forests grown alone, the written model is the one that was grown."""
import glob

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kestrel.operators import forest as FO
from kestrel.operators import models as M
from kestrel.operators import prep as P
from kestrel.plans import models_plans as MP


def binned(n, seed=1):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.integers(0, 32, (n, 4)), r.random((n, 3)) < 0.3], axis=1).astype(np.uint8)
    y = (r.random(n) < 0.15 + 0.3 * x[:, 4] + 0.01 * x[:, 0]).astype(np.uint8)
    return x, y, r.integers(-2**62, 2**62, n)


@pytest.fixture(scope="module")
def orders(spark):
    u = lambda k, n: F.pmod(F.xxhash64("order_id", F.lit(k)), F.lit(n))
    cols = {"price_inr": u(1, 5000) + 0.5, "discount_pct": u(2, 700) / 10, "customer_tenure_days": u(3, 2500), "num_previous_orders": u(4, 30),
            "num_previous_returns": u(5, 4), "delivery_distance_km": u(6, 2000) / 1.0, "delivery_days": u(7, 20), "is_weekend_order": u(8, 2),
            "rating_given": F.when(u(9, 7) > 0, u(9, 5) + 1.0), "product_category": F.element_at(F.array(*map(F.lit, "ABC")), (u(10, 3) + 1).cast("int")),
            "payment_method": F.element_at(F.array(*map(F.lit, ("COD", "Card"))), (u(11, 2) + 1).cast("int"))}
    df = spark.range(1, 3751).withColumnRenamed("id", "order_id").withColumns(cols)
    df = df.withColumn("returned", (u(12, 100) < 10 + F.col("discount_pct") / 2 + F.when(F.col("payment_method") == "COD", 30).otherwise(0)).cast("int"))
    return MP.stored(df.withColumn("split", F.when(u(13, 5) == 0, "test").otherwise("train")), "orders")


def test_every_row_of_the_train_split_is_fitted_on(spark, orders, tmp_path):
    n = orders.where("split = 'train'").count()
    assert n > 2000
    model, meta = MP.train_risk_model(spark, "unused", orders)
    assert meta["fit_rows"] == n and len(meta["cv"]) == 6
    path = str(tmp_path / "model")
    M.save_model(model, meta, path)
    forest = model.stages[-1]
    assert forest.getNumTrees == meta["best_params"]["num_trees"]
    data = glob.glob(f"{path}/versions/*/model/stages/{len(model.stages) - 1}_*/data")[0]
    roots = [r[0] for r in spark.read.parquet(data).where("nodeData.id = 0").select("nodeData.rawCount").collect()]
    assert len(roots) == forest.getNumTrees and min(roots) > 0.9 * n  # each bootstrap draws about n of n rows
    assert abs(np.mean(roots) - n) < 0.01 * n
    loaded, _ = MP.M.load_model(path, MP.PipelineModel)
    assert sum(forest.featureImportances) == pytest.approx(1) and loaded.stages[-1].featureImportances == forest.featureImportances


def test_grid_points_are_forests_grown_alone():
    x, y, keys = binned(9000)
    c, asked = FO.bootstrap(keys, 42, 3), np.arange(0, 9000, 7)
    c[asked] = 0
    together, _ = FO.grow(x, y, c, asked, [2, 6, 10, 30], (0.7, 2.0), 3, 42, 3)
    for i, d in enumerate((2, 6, 10, 30)):
        alone, nodes = FO.grow(x, y, c, asked, [d], (0.7, 2.0), 3, 42, 3, keep=True)
        assert (alone[0] == together[i]).all() and nodes[0].max() < 2 ** (d + 1)
    assert len(nodes[0]) > 500 and abs(FO.bootstrap(keys, 42, 4).mean() - 1) < 0.05


def test_levels_dealt_into_parts_and_steps(monkeypatch):
    x, y, keys = binned(4000)
    c, asked = FO.bootstrap(keys, 1, 0), np.arange(4000)
    want, nodes = FO.grow(x, y, c, asked, [4, 30], (1.0, 1.0), 3, 1, 0, keep=True)
    monkeypatch.setattr(FO, "NODES", 8)
    monkeypatch.setattr(FO, "STEP", 100)
    assert (FO.bootstrap(keys, 1, 0) == c).all()
    got, dealt = FO.grow(x, y, c, asked, [4, 30], (1.0, 1.0), 3, 1, 0, keep=True)
    assert (got == want).all() and all((a == b).all() for a, b in zip(nodes, dealt))


def test_splits_equal_plain_search():
    x, y, keys = binned(300)
    c, w = FO.bootstrap(keys, 5, 0), (0.6, 3.0)
    _, (heap, f, b, n0, n1, gain) = FO.grow(x, y, c, np.zeros(0, np.int64), [30], w, 3, 5, 0, keep=True)
    of = {1: np.arange(300)}
    gini = lambda r: (lambda a, z: 2 * a * z / (a + z) if a + z else 0.0)(w[0] * c[r][y[r] == 0].sum(), w[1] * c[r][y[r] == 1].sum())
    for i, h in enumerate(heap.tolist()):
        rows = of[h]
        assert (c[rows][y[rows] == 0].sum(), c[rows][y[rows] == 1].sum()) == (n0[i], n1[i])
        found = []
        for k in FO.node_features(np.array([h]), 7, 3, 5, 0)[0]:
            for cut in range(FO.BINS - 1):
                a, z = rows[x[rows, k] <= cut], rows[x[rows, k] > cut]
                if c[a].sum() and c[z].sum():
                    found.append(gini(a) + gini(z))
        mass = w[0] * n0[i] + w[1] * n1[i]
        best = max(0.0, (gini(rows) - min(found, default=np.inf)) / mass)
        assert best < 1e-9 if f[i] < 0 else gain[i] == pytest.approx(best)
        if f[i] >= 0:
            of[2 * h], of[2 * h + 1] = rows[x[rows, f[i]] <= b[i]], rows[x[rows, f[i]] > b[i]]
    assert len(heap) == len(of) > 20


def test_scores_and_written_model_equal_the_trees(spark):
    rows = spark.range(600).selectExpr("id", "cast(pmod(xxhash64(id, 1), 97) as double) a", "cast(id % 3 as double) b", "cast(pmod(xxhash64(id, 2), 10) + id % 3 * 2 < 5 as int) y")
    rows = rows.select("id", "y", array_to_vector(F.array("a", "b")).alias("features"))
    rows = P.kfold_assign(rows.repartition(3), "y", "id", 3)
    model, results, n = M.forest_grid_search(rows, "y", "id", n_folds=3, n_trees=(3, 5), depths=(2, 30))
    assert n == 600 and [(r["num_trees"], r["max_depth"]) for r in results] == [(3, 2), (3, 30), (5, 2), (5, 30)]
    from kestrel.operators import evaluate as E

    plain = {r.id: r for r in rows.selectExpr("id", "y", "fold", "features", "xxhash64(id) k").collect()}
    ids = sorted(plain)
    cuts = FO.thresholds(rows.select(FO.vector_to_array("features").alias("x")), "x", 2)
    assert cuts[1] == [0.5, 1.5] and len(cuts[0]) == 31
    x = np.array([[np.searchsorted(cuts[k], plain[i].features[k]) for k in range(2)] for i in ids], np.uint8)
    y, fold, keys = (np.array([plain[i][c] for i in ids], t) for c, t in (("y", np.uint8), ("fold", np.uint8), ("k", np.int64)))
    w = [600 / (2 * (y == k).sum()) for k in (0, 1)]
    for r in results:
        aucs = []
        for k in range(3):
            asked, p = np.flatnonzero(fold == k), 0
            for t in range(r["num_trees"]):
                c = np.where(fold != k, FO.bootstrap(keys, 42, t), 0).astype(np.uint8)
                p = p + FO.grow(x, y, c, asked, [r["max_depth"]], w, 2, 42, t)[0][0]
            scored = spark.createDataFrame([(int(a), float(round(b, 9))) for a, b in zip(y[asked], p)], "label int, score double")
            aucs.append(E.roc_auc(scored, "label", "score").first()[0])
        assert r["cv_roc_auc"] == pytest.approx(np.mean(aucs))
    best = max(results, key=lambda r: r["cv_roc_auc"])
    p = sum(FO.grow(x, y, FO.bootstrap(keys, 42, t), np.arange(600), [best["max_depth"]], w, 2, 42, t)[0][0] for t in range(best["num_trees"])) / best["num_trees"]
    got = {r.id: r.score for r in M.positive_score(model.transform(rows)).select("id", "score").collect()}
    assert all(got[i] == pytest.approx(v) for i, v in zip(ids, p))


def test_null_label_is_an_error(spark):
    rows = spark.range(20).selectExpr("id", "if(id = 3, null, cast(id % 2 as int)) y", "cast(id % 5 as int) fold").withColumn("features", array_to_vector(F.array(F.col("id") / 1.0)))
    with pytest.raises(ValueError, match="never null"):
        M.forest_grid_search(rows, "y", "id", n_trees=(2,), depths=(2,))
