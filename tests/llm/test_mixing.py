from pyspark.sql import functions as F

from quern.llm import mixing as M

COUNTED = "doc_id long, source string, n_tokens long, rate double"


def test_rates_shares_and_caps(spark):
    docs = [(i, " Big " if i % 2 else "BIG", 10, 0.0) for i in range(900)] + [(1000 + i, "small ", 10, 0.0) for i in range(100)] + [(2000, None, 10, 0.0), (2001, "other", 0, 0.0)]
    counted = spark.createDataFrame(docs, COUNTED).drop("rate")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.25, 3), ("never", 0.25, 5)], "source string, target_share double, max_repeats int")
    rates = M.source_rates(counted, targets)
    got = {r.source: r for r in rates.collect()}
    assert got["big"].total == 10_010 and got["big"].reachable and not got["never"].reachable and got["never"].rate == 0.0
    assert abs(got["small"].rate - 2502.5 / 1000) < 1e-9
    taken = M.copies_of(counted.withColumn("rate", F.lit("a column of this name")), rates, "doc_id").collect()
    assert {r.copies for r in taken if r.source == "small"} <= {2, 3} and {r.copies for r in taken if r.source == "big"} == {1}
    small = sum(r.copies for r in taken if r.source == "small")
    assert 235 <= small <= 265
    again = M.copies_of(counted, rates, "doc_id").collect()
    assert sorted(map(tuple, taken)) == sorted(map(tuple, again))
    rows = M.emit_copies(M.copies_of(counted, rates, "doc_id")).collect()
    assert len(rows) == sum(r.copies for r in taken) and len({(r.doc_id, r.copy_no) for r in rows}) == len(rows)


def test_unreachable_by_cap_and_empty(spark):
    counted = spark.createDataFrame([(1, "a", 10), (2, "b", 90)], "doc_id long, source string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.5, 4), ("b", 0.5, 1)], "source string, target_share double, max_repeats int")
    assert {r.source: r.reachable for r in M.source_rates(counted, targets).collect()} == {"a": False, "b": True}
    assert all(not r.tokens for r in M.source_rates(counted.limit(0), targets).collect())
