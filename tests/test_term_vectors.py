"""Sparse term vectors: one row for each text, however many terms it has."""
from kestrel.operators import retrieval as RT


def test_a_text_is_one_row(spark):
    df = spark.createDataFrame([(1, "b A aé a 7"), (2, ""), (3, None), (1, "b A aé a 7")], "k int, text string")
    rows = sorted(RT.term_vectors(df, ["k"]).collect(), key=lambda r: r.k)
    assert [(r.k, sorted(zip(r.terms, r.tfs)), r.tokens, r.norm ** 2) for r in rows if r.k != 1] == [(2, [], 0, 0.0), (3, [], 0, 0.0)]
    same = [(sorted(zip(r.terms, r.tfs)), r.tokens, round(r.norm ** 2, 9)) for r in rows if r.k == 1]
    assert same == [([("7", 1.0), ("a", 2.0), ("aé", 1.0), ("b", 1.0)], 5, 7.0)] * 2
    assert RT.term_counts(df, ["k"]).columns == ["k", "term", "tf", "norm"] and RT.term_counts(df, ["k"]).count() == 8
