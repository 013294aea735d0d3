"""Order-risk queries: features, diagnostics, binary evaluation and risk buckets."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.operators import evaluate as E
from kestrel.operators import risk
from kestrel.operators.features import FEATURE_COLUMNS, customer_history, order_base, order_features
from kestrel.plans.oracle_orders import sweep_cte, with_orders
from kestrel.plans.prep_plans import split_sql, test_scores_sql
from kestrel.plans.registry import ORACLE, register
from kestrel.session import new_folder
from kestrel.sources.tables import read_table


def scored_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, score, groups) with the closed-form F7 score as the model."""
    return order_features(spark, sf_dir).select(
        F.col("order_id").alias("id"), F.col("returned").alias("label"), F.col("prob_return").alias("score"),
        "product_category", "payment_method",
    )


def t_star(spark: SparkSession, sf_dir: str) -> float:
    """The closed-form score's best-F1 threshold on the test split: one number of a 41-row result.

    The saved forest carries its own threshold in its metadata (``models_plans``)."""
    from kestrel.plans.prep_plans import split_orders

    test = split_orders(spark, sf_dir).where("split = 'test'").select(F.col("returned").alias("label"), F.col("prob_return").alias("score"))
    best = E.best_threshold(E.threshold_sweep(test, "label", "score"))
    return float(best.select("threshold").first()[0])


@register("order_features", with_orders(
    "q AS (SELECT 1) SELECT order_id, product_category, price_inr, discount_pct, payment_method, "
    "customer_tenure_days, num_previous_orders, num_previous_returns, delivery_distance_km, delivery_days, "
    "is_weekend_order, rating_given, returned, round(prob_return, 6) AS prob_return FROM order_features"))
def q_order_features(spark, sf_dir):
    return order_features(spark, sf_dir).select(*FEATURE_COLUMNS, F.round("prob_return", 6).alias("prob_return"))


_BOUND_COLS = ["price_inr", "discount_pct", "customer_tenure_days", "num_previous_orders",
               "num_previous_returns", "delivery_distance_km", "delivery_days", "rating_given"]


@register("feature_bounds", with_orders(
    "q AS (SELECT 1) SELECT " + ", ".join(f"min({c}) AS min_{c}, max({c}) AS max_{c}" for c in _BOUND_COLS)
    + " FROM order_features"))
def q_feature_bounds(spark, sf_dir):
    df = order_features(spark, sf_dir)
    return df.agg(*[e for c in _BOUND_COLS for e in (F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}"))])


@register("customer_history", with_orders(
    "q AS (SELECT 1) SELECT order_id, customer_id, num_previous_orders, num_previous_returns, customer_tenure_days "
    "FROM order_features"))
def q_customer_history(spark, sf_dir):
    return order_features(spark, sf_dir).select(
        "order_id", "customer_id", "num_previous_orders", "num_previous_returns", "customer_tenure_days")


@register("customer_history_batches", ORACLE["customer_history"])
def q_customer_history_batches(spark, sf_dir):
    """F4 over the orders in two batches, before and from the middle day on; the second reads its own orders and the carries."""
    base = order_base(spark, sf_dir)
    day = read_table(spark, sf_dir, "orders", ["o_orderdate"]).select(F.unix_date(F.to_date("o_orderdate")).alias("d"))
    low, high = day.agg(F.min("d"), F.max("d")).first()
    middle = F.date_from_unix_date(F.lit(((low or 0) + (high or 0)) // 2))
    path = new_folder(spark, "customer-carries")
    first, second = (customer_history(base.where(half), batch=(path, i)) for i, half in enumerate(
        (F.coalesce(F.col("order_day") < middle, F.lit(True)), F.col("order_day") >= middle)))
    return first.unionByName(second).select("order_id", "customer_id", "num_previous_orders", "num_previous_returns", "customer_tenure_days")


@register("prev_return_ratio", with_orders(
    "q AS (SELECT 1) SELECT order_id, round(prev_return_ratio, 6) AS prev_return_ratio FROM order_features"))
def q_prev_return_ratio(spark, sf_dir):
    return order_features(spark, sf_dir).select("order_id", F.round("prev_return_ratio", 6).alias("prev_return_ratio"))


@register("logistic_score", with_orders(
    "q AS (SELECT 1) SELECT order_id, round(prob_return, 6) AS prob_return FROM order_features"))
def q_logistic_score(spark, sf_dir):
    return order_features(spark, sf_dir).select("order_id", F.round("prob_return", 6).alias("prob_return"))


@register("seeded_label", with_orders(
    "q AS (SELECT 1) SELECT product_category, count(*) AS n, CAST(sum(returned) AS BIGINT) AS n_returned, "
    "round(avg(prob_return), 6) AS mean_prob FROM order_features GROUP BY product_category"))
def q_seeded_label(spark, sf_dir):
    return order_features(spark, sf_dir).groupBy("product_category").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("returned").cast("long")).alias("n_returned"),
        F.round(F.avg("prob_return"), 6).alias("mean_prob"))


@register("rating_missingness", with_orders(
    "q AS (SELECT 1) SELECT payment_method, rating_given, count(*) AS n FROM order_features "
    "GROUP BY payment_method, rating_given"))
def q_rating_missingness(spark, sf_dir):
    return order_features(spark, sf_dir).groupBy("payment_method", "rating_given").agg(F.count(F.lit(1)).alias("n"))


@register("return_rate_overall", with_orders(
    "q AS (SELECT 1) SELECT count(*) AS n_rows, round(avg(CAST(returned AS DOUBLE)), 4) AS return_rate FROM order_features"))
def q_return_rate_overall(spark, sf_dir):
    return E.rate_overall(order_features(spark, sf_dir), "returned")


@register("return_rate_by_group", with_orders(
    "q AS (SELECT 1) "
    "SELECT 'product_category' AS dimension, product_category AS group_value, count(*) AS n, "
    "round(avg(CAST(returned AS DOUBLE)), 4) AS return_rate FROM order_features GROUP BY product_category "
    "UNION ALL SELECT 'payment_method', payment_method, count(*), round(avg(CAST(returned AS DOUBLE)), 4) "
    "FROM order_features GROUP BY payment_method"))
def q_return_rate_by_group(spark, sf_dir):
    return E.rate_by_group(order_features(spark, sf_dir), ["product_category", "payment_method"], "returned")


@register("missing_rate_by_payment", with_orders(
    "per AS (SELECT payment_method, count(*) AS n, sum(CASE WHEN rating_given IS NULL THEN 1 ELSE 0 END) AS n_missing "
    "FROM order_features GROUP BY payment_method) "
    "SELECT payment_method, n, round(CAST(n_missing AS DOUBLE) / n, 4) AS missing_rate, "
    "round(CAST(sum(n_missing) OVER () AS DOUBLE) / sum(n) OVER (), 4) AS overall_missing_rate, "
    "round(max(CAST(n_missing AS DOUBLE) / n) OVER () - min(CAST(n_missing AS DOUBLE) / n) OVER (), 4) AS max_min_gap "
    "FROM per"))
def q_missing_rate_by_payment(spark, sf_dir):
    return E.missing_rate_by_group(order_features(spark, sf_dir), "rating_given", "payment_method")


@register("threshold_sweep", with_orders(
    sweep_cte() + " SELECT threshold, round(f1, 6) AS f1, round(recall, 6) AS recall, "
    "round(precision, 6) AS precision FROM sweep"))
def q_threshold_sweep(spark, sf_dir):
    sw = E.threshold_sweep(scored_orders(spark, sf_dir), "label", "score")
    return sw.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "recall", "precision")])


@register("best_threshold", with_orders(
    sweep_cte() + " SELECT threshold, round(f1, 6) AS f1, round(recall, 6) AS recall, round(precision, 6) AS precision "
    "FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1"))
def q_best_threshold(spark, sf_dir):
    best = E.best_threshold(E.threshold_sweep(scored_orders(spark, sf_dir), "label", "score"))
    return best.select("threshold", *[F.round(c, 6).alias(c) for c in ("f1", "recall", "precision")])


@register("recall_gain", with_orders(
    sweep_cte() + ", b AS (SELECT threshold, recall FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1), "
    "d AS (SELECT recall FROM sweep WHERE threshold = 0.5) "
    "SELECT b.threshold AS best_threshold, round(b.recall, 4) AS best_recall, round(d.recall, 4) AS default_recall, "
    "round(round(b.recall, 4) - round(d.recall, 4), 4) AS recall_gain FROM b, d"))
def q_recall_gain(spark, sf_dir):
    return E.recall_gain(E.threshold_sweep(scored_orders(spark, sf_dir), "label", "score"))


@register("binary_metrics", with_orders(
    "c AS (SELECT sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, "
    "sum(CASE WHEN score >= 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS fp, "
    "sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn, "
    "sum(CASE WHEN score < 0.5 AND label <> 1 THEN 1 ELSE 0 END) AS tn, count(*) AS n FROM scored_orders) "
    "SELECT n, round(CAST(tp + tn AS DOUBLE) / n, 6) AS accuracy, "
    "round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 6) AS precision, "
    "round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 6) AS recall, "
    "round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END, 6) AS f1 FROM c"))
def q_binary_metrics(spark, sf_dir):
    m = E.binary_metrics(scored_orders(spark, sf_dir), "label", "score", 0.5)
    return m.select("n", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


_AUC_SQL = (
    "per AS (SELECT score, sum(CASE WHEN label = 1 THEN 1 ELSE 0 END) AS pos, "
    "sum(CASE WHEN label = 1 THEN 0 ELSE 1 END) AS neg FROM scored_orders GROUP BY score), "
    "cum AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) "
    "AS neg_below FROM per) "
    "SELECT round(sum(CAST(2 * neg_below + neg AS DOUBLE) * pos) / (2.0 * sum(pos) * sum(neg)), 6) AS roc_auc, "
    "CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM cum")


@register("roc_auc", with_orders(_AUC_SQL))
def q_roc_auc(spark, sf_dir):
    a = E.roc_auc(scored_orders(spark, sf_dir), "label", "score")
    return a.select(F.round("roc_auc", 6).alias("roc_auc"), "n_pos", "n_neg")


@register("subgroup_metrics", with_orders(
    "q AS (SELECT 1) "
    + " UNION ALL ".join(
        f"SELECT '{g}' AS dimension, {g} AS group_value, count(*) AS n, "
        "round(CASE WHEN sum(label) = 0 THEN 0.0 ELSE CAST(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) / sum(label) END, 4) AS recall, "
        "round(CASE WHEN sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) = 0 THEN 0.0 ELSE "
        "CAST(sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS DOUBLE) / sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) END, 4) AS precision "
        f"FROM scored_orders GROUP BY {g}"
        for g in ("product_category", "payment_method"))))
def q_subgroup_metrics(spark, sf_dir):
    return E.subgroup_metrics(scored_orders(spark, sf_dir), ["product_category", "payment_method"], "label", "score", 0.5)


_TEST_SWEEP = f"{split_sql()}, {test_scores_sql()}, {sweep_cte('test_scores')}"


@register("risk_bucket", with_orders(
    _TEST_SWEEP + " SELECT s.id AS order_id, round(s.score, 4) AS return_probability, "
    "CASE WHEN s.score < t.threshold THEN 'Low' WHEN s.score >= t.threshold + 0.15 THEN 'High' ELSE 'Medium' END AS risk_bucket, "
    "round(t.threshold, 4) AS low_below, round(t.threshold + 0.15, 4) AS high_at_or_above "
    "FROM scored_orders s, t_star t"))
def q_risk_bucket(spark, sf_dir):
    t = t_star(spark, sf_dir)
    b = risk.risk_bucket(scored_orders(spark, sf_dir), "score", t)
    return b.select(F.col("id").alias("order_id"), "return_probability", "risk_bucket", "low_below", "high_at_or_above")


@register("risk_flag", with_orders(
    _TEST_SWEEP + " SELECT s.id AS order_id, CASE WHEN s.score >= t.threshold THEN 'HIGH' ELSE 'LOW' END AS risk_flag "
    "FROM scored_orders s, t_star t"))
def q_risk_flag(spark, sf_dir):
    t = t_star(spark, sf_dir)
    return risk.risk_flag(scored_orders(spark, sf_dir), "score", t).select(F.col("id").alias("order_id"), "risk_flag")


@register("order_features_scan", with_orders(
    "q AS (SELECT 1) SELECT order_id, product_category, price_inr, discount_pct, payment_method, "
    "customer_tenure_days, num_previous_orders, num_previous_returns, delivery_distance_km, delivery_days, "
    "is_weekend_order, rating_given, returned FROM order_features"))
def q_order_features_scan(spark, sf_dir):
    """S1 + S2: the order table written as CSV (no index) and scanned back with its typed schema."""
    import os
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    path = os.path.join(ensure_checkpoint_dir(spark), f"orders-csv-{uuid.uuid4().hex}")
    order_features(spark, sf_dir).select(*FEATURE_COLUMNS).write.mode("overwrite").option("header", True).csv(path)
    return sinks.read_orders_csv(spark, path)


DAMAGE_EVERY = 50


@register("orders_csv_quarantine", f"""SELECT kind, count(*) AS n_records, CAST(sum(id) AS BIGINT) AS id_sum, CAST(sum(fields) AS BIGINT) AS n_fields FROM (
  SELECT o_orderkey AS id, CASE WHEN o_orderkey % {DAMAGE_EVERY} < 2 THEN 'bad' ELSE 'good' END AS kind, CASE WHEN o_orderkey % {DAMAGE_EVERY} = 1 THEN 3 ELSE 13 END AS fields
  FROM orders) GROUP BY kind""")
def q_orders_csv_quarantine(spark, sf_dir):
    """The order table as CSV with damaged records (a price that is no number, a record cut after three fields), scanned with
    its typed schema: the good rows and the quarantine, with the sums of their ids and numbers of fields."""
    import uuid

    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/damaged-csv-{uuid.uuid4().hex}"
    line = F.to_csv(F.struct(*FEATURE_COLUMNS))
    hurt = F.pmod("order_id", F.lit(DAMAGE_EVERY))
    line = F.when(hurt == 0, F.regexp_replace(line, "^([^,]*,[^,]*,)[^,]*", "$1abc")).when(hurt == 1, F.substring_index(line, ",", 3)).otherwise(line)
    order_features(spark, sf_dir).select(line.alias("value")).write.text(path)
    good, bad = sinks.split_bad_records(sinks.read_orders_csv(spark, path, header=False, on_bad="mark"))
    good = good.select(F.lit("good").alias("kind"), F.col("order_id").alias("id"), F.lit(len(FEATURE_COLUMNS)).alias("fields"))
    fields = F.split(sinks.BAD_RECORD, ",", -1)
    bad = bad.select(F.lit("bad").alias("kind"), fields[0].cast("long").alias("id"), F.size(fields).alias("fields"))
    return good.unionByName(bad).groupBy("kind").agg(F.count(F.lit(1)).alias("n_records"), F.sum("id").alias("id_sum"), F.sum("fields").alias("n_fields"))


_F1 = "CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / (2 * tp + fp + fn) END"
_GROUPS_SQL = " UNION ALL ".join(
    f"SELECT '{g}' AS dim, {g} AS item, count(*) AS n, sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, "
    f"sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END) AS pp, sum(label) AS p FROM tscored GROUP BY {g}" for g in ("product_category", "payment_method"))


@register("evaluation_report", with_orders(f"""{split_sql()}, {test_scores_sql()}, {sweep_cte('test_scores')},
tscored AS (SELECT returned AS label, prob_return AS score, product_category, payment_method FROM test),
m AS (SELECT sum(CASE WHEN score >= 0.5 AND label = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN score >= 0.5 AND label = 0 THEN 1 ELSE 0 END) AS fp,
      sum(CASE WHEN score < 0.5 AND label = 1 THEN 1 ELSE 0 END) AS fn, sum(CASE WHEN score < 0.5 AND label = 0 THEN 1 ELSE 0 END) AS tn FROM tscored),
b AS (SELECT * FROM sweep ORDER BY f1 DESC, threshold ASC LIMIT 1),
gr AS ({_GROUPS_SQL})
SELECT 'closed_form_default' AS section, 'all' AS item, 'accuracy' AS metric, round(CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn), 4) AS value FROM m
UNION ALL SELECT 'closed_form_default', 'all', 'precision', round(CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fp) END, 4) FROM m
UNION ALL SELECT 'closed_form_default', 'all', 'recall', round(CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / (tp + fn) END, 4) FROM m
UNION ALL SELECT 'closed_form_default', 'all', 'f1', round({_F1}, 4) FROM m
UNION ALL SELECT 'closed_form_best_threshold', 'all', 'threshold', threshold FROM b
UNION ALL SELECT 'closed_form_best_threshold', 'all', 'f1', round(f1, 4) FROM b
UNION ALL SELECT 'closed_form_best_threshold', 'all', 'recall', round(recall, 4) FROM b
UNION ALL SELECT 'closed_form_best_threshold', 'all', 'precision', round(precision, 4) FROM b
UNION ALL SELECT dim, item, 'n', CAST(n AS DOUBLE) FROM gr
UNION ALL SELECT dim, item, 'recall', round(CASE WHEN p = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / p END, 4) FROM gr
UNION ALL SELECT dim, item, 'precision', round(CASE WHEN pp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / pp END, 4) FROM gr"""))
def q_evaluation_report(spark, sf_dir):
    """The nested report of the closed-form score on the test split, written as JSON by the sink, read back
    and flattened to (section, item, metric, value) rows."""
    import uuid

    from kestrel.plans.prep_plans import split_orders
    from kestrel.session import ensure_checkpoint_dir
    from kestrel.sources import sinks

    test = split_orders(spark, sf_dir).where("split = 'test'").select(
        F.col("returned").alias("label"), F.col("prob_return").alias("score"), "product_category", "payment_method")
    metrics = ["accuracy", "precision", "recall", "f1"]
    best_of = ["threshold", "f1", "recall", "precision"]
    m = E.binary_metrics(test, "label", "score", 0.5).select(F.struct(*[F.round(c, 4).alias(c) for c in metrics]).alias("closed_form_default"))
    best = E.best_threshold(E.threshold_sweep(test, "label", "score")).select(
        F.struct(*[F.round(c, 4).alias(c) for c in best_of]).alias("closed_form_best_threshold"))
    sub = E.subgroup_metrics(test, ["product_category", "payment_method"], "label", "score", 0.5)
    groups = sub.agg(F.array_sort(F.collect_list(F.struct("dimension", "group_value", "n", "recall", "precision"))).alias("subgroups"))
    one = lambda df: df.withColumn("k", F.lit(1))  # noqa: E731  (each side is one row)
    path = f"{ensure_checkpoint_dir(spark)}/report-{uuid.uuid4().hex}"
    sinks.write_report_json(one(m).join(one(best), "k").join(one(groups), "k").drop("k"), path)
    back = spark.read.json(path)
    parts = [F.struct(F.lit(s).alias("section"), F.lit("all").alias("item"), F.lit(c).alias("metric"), F.col(f"{s}.{c}").cast("double").alias("value"))
             for s, cs in (("closed_form_default", metrics), ("closed_form_best_threshold", best_of)) for c in cs]
    flat = back.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    g = back.select(F.explode("subgroups").alias("g")).select(F.explode(F.array(*[
        F.struct(F.col("g.dimension").alias("section"), F.col("g.group_value").alias("item"), F.lit(c).alias("metric"), F.col(f"g.{c}").cast("double").alias("value"))
        for c in ("n", "recall", "precision")])).alias("x")).select("x.*")
    return flat.unionByName(g)
