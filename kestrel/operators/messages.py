"""Support-message processing as a batch job over a turns table.

One row per user turn ``(conv_id, turn, text)``.  Guardrail, intent and routing are column
expressions; per-conversation state (carried order details, last image path) is a
``running_scan`` keyed by ``conv_id`` and ordered by ``turn``, so each branch runs as a
filter + join, never as per-row dispatch, and a very long conversation is still split
across tasks.
"""
from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kestrel.functions import text_rules as T
from kestrel.functions.rules import logistic_score, safe_div
from kestrel.operators.retrieval import GROUNDEDNESS_THRESHOLD
from kestrel.operators.risk import risk_bucket_col
from kestrel.operators.incremental import incremental_scan
from kestrel.operators.scan import running_scan


# ------------------------------------------------------------------ C1-C5
def guard_and_route(turns: DataFrame, text: str = "text") -> DataFrame:
    """C1 + C4 + C5: blocked flag and pattern, intent and method, route."""
    t = F.col(text)
    df = turns.withColumn("injection_pattern", T.injection_pattern(t))
    df = df.withColumn("blocked", F.col("injection_pattern").isNotNull())
    ci = T.classify_intent(t)
    df = df.withColumn("intent", F.when(~F.col("blocked"), ci["intent"])) \
           .withColumn("intent_method", F.when(~F.col("blocked"), ci["method"]))
    route = (F.when(F.col("blocked"), F.lit("deflect"))
             .when(F.col("intent") == T.POLICY, F.lit("retrieve")).otherwise(F.lit("tool")))
    return df.withColumn("route", route)


# ------------------------------------------------------------------ C6-C9, C12
def carry_context(routed: DataFrame, text: str = "text", num_blocks: int | None = None, batch: tuple[str, int] | None = None) -> DataFrame:
    """C9 (+ C8): resolve the order features and image path each turn acts on.

    A risk turn uses its own text's features when it mentions details or when no earlier
    risk turn set any; otherwise the carried ones.  The carried features therefore come
    from the latest detailed risk turn so far, or else from the conversation's first risk
    turn.  The image path is the latest path named on an image turn.  New conversations
    start empty (the scan key is ``conv_id``).  With ``batch`` (state folder, number), ``routed`` holds the turns of one
    batch only and what they carry comes from the batches before it (``incremental_scan``).
    """
    t = F.col(text)
    is_risk = F.col("intent") == T.RISK
    is_image = F.col("intent") == T.IMAGE
    df = routed.withColumn("mentions_details", T.mentions_details(t)).withColumns({
        "_detail_text": F.when(is_risk & F.col("mentions_details"), t),
        "_risk_text": F.when(is_risk, t),
        "_path_here": F.when(is_image, T.image_path(t)),
    })
    scan = partial(incremental_scan, path=batch[0], batch=batch[1]) if batch else running_scan
    df = scan(df, ["conv_id"], ["turn"], {
        "_last_detail": ("last", "_detail_text", True),
        "_first_risk": ("first_nonnull", "_risk_text", True),
        "image_path": ("last", "_path_here", True),
    }, num_blocks=num_blocks)
    src = F.coalesce(F.col("_last_detail"), F.col("_first_risk"))
    df = df.withColumn("features_source_text", F.when(is_risk, src))
    df = df.withColumn("order_features", F.when(is_risk, T.extract_order_features(src)))
    return df.withColumn("image_path", F.when(is_image, F.col("image_path"))) \
             .drop("_detail_text", "_risk_text", "_path_here", "_last_detail", "_first_risk")


def score_features(f: Column) -> Column:
    """The closed-form return probability (F7) of a resolved feature struct."""
    return logistic_score(
        safe_div(f["num_previous_returns"], f["num_previous_orders"]), f["product_category"], f["discount_pct"],
        f["payment_method"], f["delivery_days"], f["price_inr"], f["is_weekend_order"], f["customer_tenure_days"],
    )


# ------------------------------------------------------------------ M9 with a fixed scorer
def class_means(vectors: DataFrame, n_classes: int, label: str = "label", vec: str = "embedding") -> DataFrame:
    """``label`` and its mean vector: one aggregation of vectors (no row per element).

    Any label outside 0 .. n_classes - 1 is an error, not a row left out.
    """
    known = F.col(label).between(0, n_classes - 1)
    checked = F.when(known, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("unknown label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int"))
    rows = vectors.select(checked.alias(label), array_to_vector(F.col(vec)).alias("_v"))
    return rows.groupBy(label).agg(Summarizer.mean(F.col("_v")).alias("_m")).select(label, vector_to_array("_m").alias(vec))


def class_centroids(vectors: DataFrame, label: str = "label", vec: str = "embedding") -> list[list[float]]:
    """The class means in label order (None for a class without rows): classes x dimensions numbers."""
    by_label = {r[0]: list(r[1]) for r in class_means(vectors, len(T.CLASS_NAMES), label, vec).collect()}
    return [by_label.get(i) for i in range(len(T.CLASS_NAMES))]


def softmax_classify(df: DataFrame, centroids: list[list[float]], vec: str = "embedding") -> DataFrame:
    """M9: logits = dot(vector, centroid_c); softmax; argmax (first on ties); 4 dp outputs.

    The class probabilities come from an Arrow-batched pandas UDF (one numpy matrix product
    per batch against the classes x dims centroid matrix); written as column expressions,
    the centroids became hundreds of literals that every adaptive re-plan re-optimised.
    """
    dim = max((len(c) for c in centroids if c is not None), default=0)
    cmat = np.array([c if c is not None else [0.0] * dim for c in centroids], dtype=np.float64)
    missing = np.array([c is None for c in centroids])

    @F.pandas_udf("array<double>")
    def class_probs(v: pd.Series) -> pd.Series:
        if len(v) == 0:
            return pd.Series([], dtype=object)
        m = np.stack(v.to_numpy()).astype(np.float64)
        logits = m @ cmat.T
        logits[:, missing] = -np.inf
        ex = np.exp(logits - logits.max(axis=1, keepdims=True))
        probs = ex / ex.sum(axis=1, keepdims=True)
        return pd.Series(list(probs))

    out = df.withColumn("_probs", class_probs(F.col(vec)))
    pred = F.array_position(F.col("_probs"), F.array_max(F.col("_probs"))) - 1
    return out.select(
        "*",
        pred.cast("int").alias("pred"),
        F.element_at(F.array(*[F.lit(n) for n in T.CLASS_NAMES]), (pred + 1).cast("int")).alias("predicted_class"),
        F.round(F.array_max(F.col("_probs")), 4).alias("confidence"),
        F.map_from_arrays(F.array(*[F.lit(n) for n in T.CLASS_NAMES]),
                          F.transform(F.col("_probs"), lambda p: F.round(p, 4))).alias("all_probabilities"),
    ).drop("_probs")


# ------------------------------------------------------------------ C11
def compose_answer(df: DataFrame, t_star: float) -> DataFrame:
    """C11: the final answer struct per turn from the branch outputs already joined in.

    Expects ``route``, ``intent``, ``risk_p`` (risk turns), ``top1_*``/``top2_*`` chunk
    columns (policy turns) and ``predicted_class``/``confidence`` (image turns).
    """
    top = F.coalesce(F.col("top1_score"), F.lit(0.0))
    grounded = top >= GROUNDEDNESS_THRESHOLD
    policy_text = F.when(F.col("top2_doc") == F.col("top1_doc"),
                         F.concat_ws(" ", F.col("top1_text"), F.col("top2_text"))).otherwise(F.col("top1_text"))
    refusal = T.render(T.UNGROUNDED_ANSWER, top=F.round(top, 4).cast("string"), thr=F.lit(str(GROUNDEDNESS_THRESHOLD)))
    p = F.round(F.col("risk_p"), 4)
    bucket = risk_bucket_col(F.col("risk_p"), F.lit(float(t_star)))
    risk_text = T.render(T.RISK_ANSWER, pct=T.percent0(p), bucket=bucket, t=F.lit(repr(float(t_star))))
    image_text = F.coalesce(T.render(T.IMAGE_ANSWER, cls=F.col("predicted_class"), pct=T.percent0(F.col("confidence"))),
                            F.lit(T.NO_IMAGE_ANSWER))
    answer = (F.when(F.col("route") == "deflect", F.lit(T.DEFLECTION_ANSWER))
              .when((F.col("intent") == T.POLICY) & grounded, policy_text)
              .when(F.col("intent") == T.POLICY, refusal)
              .when(F.col("intent") == T.RISK, risk_text)
              .when(F.col("intent") == T.IMAGE, image_text))
    source = (F.when(F.col("route") == "deflect", F.lit("policy_kb"))
              .when(F.col("intent") == T.POLICY, F.lit("policy_kb"))
              .when(F.col("intent") == T.RISK, F.lit("return_risk_tool"))
              .when(F.col("intent") == T.IMAGE, F.lit("image_classifier_tool")))
    conf = (F.when(F.col("route") == "deflect", F.lit(0.0))
            .when((F.col("intent") == T.POLICY) & grounded, F.round(top, 4))
            .when(F.col("intent") == T.POLICY, F.lit(0.0))
            .when(F.col("intent") == T.RISK, p)
            .when(F.col("intent") == T.IMAGE, F.coalesce(F.round(F.col("confidence"), 4), F.lit(0.0))))
    return df.withColumns({"risk_bucket": F.when(F.col("intent") == T.RISK, bucket),
                           "answer": answer, "source": source, "answer_confidence": conf})
