"""A long text is cut into tokens once for all exemplars."""
from pyspark.sql import functions as F

from kestrel.functions import text_rules as T
from kestrel.plans.messages_plans import scan_messages


def test_exemplars_share_one_list_of_tokens(spark):
    texts = [ex for ex, _ in T.FEW_SHOT_EXAMPLES] + [f"Word, {ex.upper()} and  {ex}\nmore" for ex, _ in T.FEW_SHOT_EXAMPLES] + ["", None, "nothing of it"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = scan_messages(df)
    want = df.select("doc_id", T.exemplar_intent(F.col("text")).alias("exemplar_intent"))
    assert sorted(map(tuple, got.select("doc_id", "exemplar_intent").collect())) == sorted(map(tuple, want.collect()))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
