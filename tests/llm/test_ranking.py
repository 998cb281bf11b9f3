from quern.llm import ranking

RETRIEVED = "query_id string, chunk_id string, fused_score double, rerank_score double, closeness double"
SCORED = "query_id string, chunk_id string, score double, similarity double"


def rank(spark, rows, lexical=(), vector=()):
    c = ranking.candidates(spark.createDataFrame(list(rows), RETRIEVED), spark.createDataFrame(list(lexical), SCORED), spark.createDataFrame(list(vector), SCORED))
    return {r.chunk_id: r.closeness for r in ranking.closeness(c, "query_id", ranking.SCORES).collect()}


def test_no_score_rules_by_its_range(spark):
    rows = [("q", f"c{i}", 0.01 * i, 10.0 - i, 9.9) for i in range(8)]  # an extra column named closeness
    wide = [("q", f"c{i}", 1000.0 * i, None) for i in range(8)]
    narrow = [("q", f"c{i}", 5e7 * i, None) for i in range(8)]
    a, b = rank(spark, rows, wide), rank(spark, rows, narrow)
    assert a == b


def test_absent_scores_nulls_and_repeats(spark):
    rows = [("q", "a", 0.9, None, None), ("q", "a", 0.9, None, None), ("q", "b", 0.1, None, None), ("q", "n", None, float("nan"), None), (None, "x", 1.0, 1.0, None)]
    got = rank(spark, rows, [("q", "z", 5.0, None)])
    assert set(got) == {"a", "b", "n"} and got["a"] == 1.0 and got["b"] == 0.0 and got["n"] is None


def test_all_tied_and_empty(spark):
    assert set(rank(spark, [("q", "a", 0.5, 1.0, None), ("q", "b", 0.5, 1.0, None)]).values()) == {None}
    assert rank(spark, []) == {}
