"""Preparation queries over the order table: split, folds, imputation, scaling, encoding."""
from __future__ import annotations

from pyspark.sql import functions as F

from kestrel.functions.hashing import uniform_sql
from kestrel.operators import models as M
from kestrel.operators import prep as P
from kestrel.operators.features import CATEGORICAL_FEATURES, NUMERIC_FEATURES, held_order_features
from kestrel.plans.oracle_orders import with_orders
from kestrel.plans.registry import register
from kestrel.session import stored

TEST_FRACTION = 0.2


def split_orders(spark, sf_dir, columns=None):
    """The order table (or ``columns`` of it) with its split, both written once: passes over it read columns of files."""
    orders = held_order_features(spark, sf_dir, columns)
    return stored(P.stratified_split(orders, "returned", "order_id", TEST_FRACTION), "orders-split")


def split_sql(fraction: float = TEST_FRACTION) -> str:
    return f"""cnt AS (SELECT returned AS label, count(*) AS n_c FROM order_features GROUP BY returned),
q0 AS (SELECT label, n_c, sum(n_c) OVER () AS n, CAST(ceil(round({fraction} * sum(n_c) OVER (), 9)) AS BIGINT) AS nt FROM cnt),
q1 AS (SELECT *, (nt * n_c) // n AS base, (nt * n_c) % n AS rem FROM q0),
q2 AS (SELECT *, nt - sum(base) OVER () AS lft, row_number() OVER (ORDER BY rem DESC, label ASC) AS rk FROM q1),
quotas AS (SELECT label, base + CASE WHEN rk <= lft THEN 1 ELSE 0 END AS quota FROM q2),
ranked AS (SELECT o.*, row_number() OVER (PARTITION BY returned ORDER BY {uniform_sql('order_id', 'split')}, order_id) - 1 AS pos
           FROM order_features o),
split AS (SELECT r.*, CASE WHEN r.pos < q.quota THEN 'test' ELSE 'train' END AS split
          FROM ranked r JOIN quotas q ON r.returned = q.label),
train AS (SELECT * FROM split WHERE split = 'train'),
test AS (SELECT * FROM split WHERE split = 'test')"""


def test_scores_sql() -> str:
    return "test_scores AS (SELECT order_id AS id, returned AS label, prob_return AS score FROM test)"


@register("stratified_split", with_orders(split_sql() + " SELECT order_id, returned, split FROM split"))
def q_stratified_split(spark, sf_dir):
    return split_orders(spark, sf_dir).select("order_id", "returned", "split")


_MED_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS column, round(median({c}), 6) AS median FROM train" for c in NUMERIC_FEATURES)


@register("impute_median", with_orders(split_sql() + " " + _MED_SQL))
def q_impute_median(spark, sf_dir):
    train = split_orders(spark, sf_dir).where("split = 'train'")
    medians = P.exact_medians(train, NUMERIC_FEATURES)
    out = spark.createDataFrame(list(medians.items()), "column string, median double")
    return out.select("column", F.round("median", 6).alias("median"))


@register("impute_mode", with_orders(split_sql() + " " + " UNION ALL ".join(
    f"SELECT '{c}' AS column, (SELECT {c} FROM train GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1) AS mode"
    for c in CATEGORICAL_FEATURES)))
def q_impute_mode(spark, sf_dir):
    train = split_orders(spark, sf_dir).where("split = 'train'")
    return P.modes(train, CATEGORICAL_FEATURES)


def _scaled_sql() -> str:
    meds = ", ".join(f"(SELECT median({c}) FROM train) AS med_{c}" for c in NUMERIC_FEATURES)
    imputed = ", ".join(f"coalesce(CAST(s.{c} AS DOUBLE), m.med_{c}) AS {c}" for c in NUMERIC_FEATURES)
    stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in NUMERIC_FEATURES)
    outs = ", ".join(
        f"round((i.{c} - st.mu_{c}) / (CASE WHEN st.sd_{c} = 0 OR st.sd_{c} IS NULL THEN 1.0 ELSE st.sd_{c} END), 6) AS {c}"
        for c in NUMERIC_FEATURES)
    return (f", meds AS (SELECT {meds}), imp AS (SELECT s.order_id, s.split, {imputed} FROM split s, meds m), "
            f"st AS (SELECT {stats} FROM imp WHERE split = 'train') "
            f"SELECT i.order_id, {outs} FROM imp i, st")


@register("standard_scale", with_orders(split_sql() + _scaled_sql()))
def q_standard_scale(spark, sf_dir):
    df = split_orders(spark, sf_dir)
    df = df.select("order_id", "split", *[F.col(c).cast("double").alias(c) for c in NUMERIC_FEATURES])
    train = df.where("split = 'train'")
    meds = P.exact_medians(train, NUMERIC_FEATURES)
    df = P.impute(df, meds)
    stats = P.scaling_stats(df.where("split = 'train'"), NUMERIC_FEATURES)
    out = P.standard_scale(df, stats)
    return out.select("order_id", *[F.round(c, 6).alias(c) for c in NUMERIC_FEATURES])


@register("one_hot", with_orders(split_sql() + " SELECT order_id, " + ", ".join(
    [f"CASE WHEN product_category = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS product_category_{v}"
     for v in sorted(["Apparel", "Electronics", "Home", "Footwear", "Beauty"])]
    + [f"CASE WHEN payment_method = '{v}' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS payment_method_{v}"
       for v in sorted(["COD", "Prepaid_Card", "Prepaid_UPI", "Wallet"])]) + " FROM split"))
def q_one_hot(spark, sf_dir):
    df = split_orders(spark, sf_dir)
    model = P.one_hot_model(df.where("split = 'train'"), CATEGORICAL_FEATURES)
    out = P.one_hot_columns(model, df, CATEGORICAL_FEATURES)
    return out.select("order_id", *P.one_hot_names(model, CATEGORICAL_FEATURES))


@register("class_weights", with_orders(split_sql() + " SELECT returned, count(*) AS n_c, "
          "round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight "
          "FROM train GROUP BY returned"))
def q_class_weights(spark, sf_dir):
    train = split_orders(spark, sf_dir).where("split = 'train'")
    w = P.class_weights(train, "returned")
    return w.select("returned", "n_c", F.round("weight", 6).alias("weight"))


@register("kfold_assign", with_orders(split_sql() + " SELECT order_id, returned, CAST((row_number() OVER ("
          f"PARTITION BY returned ORDER BY {uniform_sql('order_id', 'fold')}, order_id) - 1) % 5 AS INTEGER) AS fold "
          "FROM train"))
def q_kfold_assign(spark, sf_dir):
    train = split_orders(spark, sf_dir).where("split = 'train'")
    return P.kfold_assign(train.select("order_id", "returned"), "returned", "order_id", 5)


@register("baseline_majority", with_orders(split_sql() + ", maj AS (SELECT returned AS m FROM train GROUP BY returned "
          "ORDER BY count(*) DESC, returned ASC LIMIT 1), "
          "c AS (SELECT count(*) AS n, sum(CASE WHEN t.returned = maj.m THEN 1 ELSE 0 END) AS correct, "
          "sum(CASE WHEN maj.m = 1 AND t.returned = 1 THEN 1 ELSE 0 END) AS tp, "
          "sum(CASE WHEN maj.m = 1 AND t.returned <> 1 THEN 1 ELSE 0 END) AS fp, "
          "sum(CASE WHEN maj.m <> 1 AND t.returned = 1 THEN 1 ELSE 0 END) AS fn FROM test t, maj) "
          "SELECT (SELECT m FROM maj) AS majority_label, round(CAST(correct AS DOUBLE) / n, 4) AS accuracy, "
          "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 4) AS f1_class1 FROM c"))
def q_baseline_majority(spark, sf_dir):
    df = split_orders(spark, sf_dir)
    return M.baseline_majority(df.where("split = 'train'"), df.where("split = 'test'"), "returned")
