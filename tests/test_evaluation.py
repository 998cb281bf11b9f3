import math

from pyspark.sql import functions as F

from quern.operators import evaluation as E, query_processing as Q


def test_decisions(spark):
    rows = [("a", True, True), ("a", True, False), ("a", False, False), ("a", False, None), ("a", None, True), ("b", True, True), ("b", True, None)]
    got = {r.f: (r.n, r.recall, r.precision, r.specificity, r.accuracy) for r in E.decision_metrics(spark.createDataFrame(rows, "f string, t boolean, p boolean"), F.col("t"), F.col("p"), "f").collect()}
    assert got == {"a": (4, 0.5, 1.0, 1.0, 0.75), "b": (2, 0.5, 1.0, None, 0.5)}


def test_rankings_by_brute_force(spark):
    rows = [("q", k, k in (2, 5)) for k in range(1, 8)] + [("p", 1, True), ("p", 2, None), ("n", 1, False)]
    got = E.ranking_metrics(spark.createDataFrame(rows, "query_id string, position int, r boolean"), F.col("r"), 3).first()
    gain = lambda *ks: sum(1 / math.log2(k + 1) for k in ks)
    assert (got.queries, got.top_1, got.mrr, got.recall_3) == (2, 0.5, 0.75, 0.75)
    assert got.ndcg_3 == round((1 + gain(2) / gain(1, 2)) / 2, 6)
    empty = E.ranking_metrics(spark.createDataFrame([], "query_id string, position int, r boolean"), F.col("r"), 3).first()
    assert empty.queries == 0 and empty.mrr is None


def test_queries_are_processed_by_language(spark):
    texts = ["  Epdi iruku,  sir?", "the rent is due", "வாடகை எப்போது", "12", None]
    got = [r for r in Q.process(spark.createDataFrame(list(enumerate(texts)), "i int, t string"), "t").orderBy("i").collect()]
    assert (got[0].normalized, got[0].language, got[0].expansions) == ("Epdi iruku, sir?", "tanglish", ["eppadi irukku, sir?"]) and got[0].transliterated != got[0].normalized
    assert all(r.transliterated == r.normalized and r.expansions == [] for r in got[1:4]) and got[3].limitations == ["no_letters"]
    assert got[4].normalized is None
    swapped = Q.process(spark.createDataFrame([("epdi iruku",)], "t string"), "t", spelling=lambda c: F.upper(c), transliterator=lambda c: F.reverse(c)).first()
    assert (swapped.transliterated, swapped.expansions) == ("UKURI IDPE", ["EPDI IRUKU"])
    as_json = Q.process(spark.createDataFrame([("the rent",)], "t string"), "t").select(Q.view().alias("j")).first().j
    assert '"detection":{"language":"eng","confidence":0.9,"limitations":[]}' in as_json
