"""A query builds the order table once, however often it fits, scores and evaluates."""
import pytest

from __spark_entry__ import SF_SMOKE, queries
from kestrel.operators import features as FT
from kestrel.operators import prep as P


@pytest.mark.parametrize("name", ["model_roundtrip", "feature_slots"])
def test_orders_are_built_and_written_once(spark, monkeypatch, name):
    built, build = [], FT.build_order_features
    monkeypatch.setattr(FT, "build_order_features", lambda *a: built.append(1) or build(*a))
    inputs, fit = [], P.exact_medians
    monkeypatch.setattr(P, "exact_medians", lambda df, cols: inputs.append(len(df.inputFiles())) or fit(df, cols))
    assert queries()[name](spark, SF_SMOKE).count() > 0
    assert len(built) == 1 and inputs[0] > 0  # fitted on files, not on what would be worked out anew


def test_median_of_a_column_of_few_values(spark):
    df = spark.range(30_001).selectExpr("cast(id % 2 as int) a", "cast(id as double) b", "if(id < 20000, 3, 9) c")
    assert P.exact_medians(df, ["a", "b", "c"]) == {"a": 0.0, "b": 15000.0, "c": 3.0}
