"""Measures of rankings and of yes-or-no decisions against labelled rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _share(part: Column, whole: Column) -> Column:
    return F.round(part / F.nullif(whole, F.lit(0)), 6)


def decision_metrics(df: DataFrame, truth: Column, predicted: Column, *facets: str) -> DataFrame:
    """(facets, n, recall, precision, specificity, accuracy) of a yes-or-no decision; null where
    there is nothing to measure. Rows whose truth is null are left out, an absent prediction
    counts as no."""
    rows = df.withColumn("_t", truth).withColumn("_p", F.coalesce(predicted, F.lit(False))).where("_t is not null")
    both = F.count_if(F.col("_t") & F.col("_p"))
    neither = F.count_if(~F.col("_t") & ~F.col("_p"))
    return rows.groupBy(*facets).agg(
        F.count("*").alias("n"), _share(both, F.count_if("_t")).alias("recall"), _share(both, F.count_if("_p")).alias("precision"), _share(neither, F.count_if(~F.col("_t"))).alias("specificity"),
        _share(F.count_if(F.col("_t") == F.col("_p")), F.count("*")).alias("accuracy"),
    )


def ranking_metrics(ranked: DataFrame, relevant: Column, *depths: int) -> DataFrame:
    """One row with the number of queries that have relevant rows, top-1 accuracy, mean reciprocal
    rank, and recall and nDCG at each depth. ``ranked`` has query_id and position from 1; gains
    are 1 or 0."""
    rows = ranked.withColumn("_r", F.coalesce(relevant, F.lit(False)))
    gain = lambda k: F.sum(F.when(F.col("_r") & (F.col("position") <= k), 1 / F.log2(F.col("position") + 1)).otherwise(0.0))
    per = rows.groupBy("query_id").agg(
        F.count_if("_r").alias("n"), F.min(F.when(F.col("_r"), F.col("position"))).alias("first"),
        *[F.count_if(F.col("_r") & (F.col("position") <= k)).alias(f"hits_{k}") for k in depths], *[gain(k).alias(f"gain_{k}") for k in depths],
    ).where("n > 0")
    ideal = lambda k: F.aggregate(F.sequence(F.lit(1), F.least(F.col("n").cast("int"), F.lit(k))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    mean = lambda c, name: F.round(F.avg(c), 6).alias(name)
    return per.agg(
        F.count("*").alias("queries"), mean(F.when(F.col("first") == 1, 1.0).otherwise(0.0), "top_1"), mean(1 / F.col("first"), "mrr"),
        *reduce(lambda a, k: [*a, mean(F.col(f"hits_{k}") / F.col("n"), f"recall_{k}"), mean(F.col(f"gain_{k}") / ideal(k), f"ndcg_{k}")], depths, []),
    )
