"""AUC of several scores of one row, taken as packed lists by score bin."""
from pyspark.sql import functions as F

from kestrel.operators import evaluate as E


def test_scores_of_a_row_have_the_auc_of_each(spark):
    """Ties, nulls, several bins and a group without positives."""
    df = spark.range(900).select((F.col("id") % 3).cast("int").alias("g"), F.when(F.col("id") % 3 == 2, 0).otherwise((F.col("id") % 7 < 3).cast("int")).alias("y"),
                                 ((F.col("id") * 37 % 101) / 101.0).alias("a"), F.when(F.col("id") % 5 > 0, F.col("id") % 11 / 10.0).alias("b"))
    scores = [F.col("a"), F.col("b"), F.lit(0.5)]
    got = {(r.s, r.g): r.roc_auc for r in E.roc_auc_of_scores(df, "y", scores, "g", 40 * E.PACK_ROWS).collect()}
    one = df.select("g", "y", F.explode(F.array(*[F.struct(F.lit(i).alias("s"), s.alias("x")) for i, s in enumerate(scores)])).alias("v")).select("g", "y", "v.s", "v.x")
    want = {(r.s, r.g): r.roc_auc for r in E.roc_auc(one, "y", "x", by=["s", "g"]).collect()}
    assert got == want and len(got) == 9 and got[0, 2] is None and got[2, 0] == 0.5
