"""One ranking from several differently scaled scores (problem 1).

TOPSIS per query: each score is winsorised at two percentiles of the query's candidates, centred
on the middle of these bounds and vector-normalised; a candidate's relative closeness is
d(anti-ideal) / (d(ideal) + d(anti-ideal)) under weighted distances, all weights being 1 by
default. The norm is divided by the root of the count, as a score may be absent from many
candidates. Centred on their lower bound, or not at all, scores would weigh the more the more
evenly they are spread or the narrower their band lies.

Nothing is done per query in one task: percentiles are mergeable sketches, norms are partial
sums, and only a few numbers per query are joined back, so a query with most of the rows is
spread like any other; the final top-k is limited before its shuffle.

Results: absent scores (null, NaN) are left out of both distances, which are means over the
scores a candidate has. Candidates without any score have closeness null and come last. Where
all candidates tie in a score, it counts for none of them. Ties in closeness go by chunk_id.
Re-delivered rows count once (the greatest value, should they differ); rows with a null key
are dropped, empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.common import table

LOW, HIGH = 0.1, 0.9
ACCURACY = 10_000


def candidates(retrieved: DataFrame, lexical: DataFrame, vector: DataFrame) -> DataFrame:
    """(query_id, chunk_id, fused, rerank, lexical, vector), one row per chunk found for a
    query: a union and one aggregation instead of two joins."""
    names = ("fused", "rerank", "lexical", "vector")

    def part(df: DataFrame, found: bool, **cols: str) -> DataFrame:
        score = lambda n: F.when(~F.isnan(cols[n]), F.col(cols[n])) if n in cols else F.lit(None).cast("double")
        return df.select("query_id", "chunk_id", F.lit(found).alias("found"), *[score(n).alias(n) for n in names])

    rows = part(retrieved, True, fused="fused_score", rerank="rerank_score").unionByName(part(lexical, False, lexical="score")).unionByName(part(vector, False, vector="similarity"))
    return (
        rows.where("query_id is not null and chunk_id is not null")
        .groupBy("query_id", "chunk_id").agg(F.max("found").alias("found"), *[F.max(n).alias(n) for n in names])
        .where("found").drop("found")
    )


def closeness(df: DataFrame, query: str, scores: list[str], importance: dict[str, float] | None = None) -> DataFrame:
    """df with ``closeness``, in [0, 1]."""
    weights = {s: (importance or {}).get(s, 1.0) for s in scores}
    bounds = df.groupBy(query).agg(*[F.percentile_approx(s, [LOW, HIGH], ACCURACY).alias(f"b_{s}") for s in scores])
    low, high = (lambda s: F.col(f"b_{s}")[0]), (lambda s: F.col(f"b_{s}")[1])
    clipped = df.join(bounds, query).select(*df.columns, *[F.when(F.col(s).isNotNull(), F.least(F.greatest(F.col(s), low(s)), high(s))).alias(f"w_{s}") for s in scores], *[f"b_{s}" for s in scores])
    centred = {s: F.col(f"w_{s}") - (low(s) + high(s)) / 2 for s in scores}
    norms = clipped.groupBy(query).agg(*[F.sqrt(F.avg(F.when(high(s) > low(s), centred[s] * centred[s]))).alias(f"n_{s}") for s in scores])

    def distance(to: str) -> Column:
        """Weighted root mean square over the present scores to their ideal or anti-ideal."""
        terms, shares = [], []
        for s in scores:
            gap = (high(s) - F.col(f"w_{s}") if to == "ideal" else F.col(f"w_{s}") - low(s)) / F.col(f"n_{s}")
            terms.append(F.coalesce(F.pow(gap * F.lit(weights[s]), 2), F.lit(0.0)))
            shares.append(F.when(gap.isNotNull(), F.lit(weights[s])).otherwise(0.0))
        return F.sqrt(sum(terms[1:], terms[0]) / F.nullif(sum(shares[1:], shares[0]), F.lit(0.0)))

    worst, best = distance("anti"), distance("ideal")
    return clipped.join(norms, query).select(*df.columns, F.round(worst / F.nullif(worst + best, F.lit(0.0)), 9).alias("closeness"))


SCORES = ["fused", "rerank", "lexical", "vector"]


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = candidates(table(spark, sf_dir, "retrieved_chunks"), table(spark, sf_dir, "lexical_matches"), table(spark, sf_dir, "vector_matches"))
    order = Window.partitionBy("query_id").orderBy(F.col("closeness").desc_nulls_last(), "chunk_id")
    return closeness(found, "query_id", SCORES).select("query_id", "chunk_id", "closeness").withColumn("position", F.row_number().over(order))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(spark, sf_dir).where("position <= 3").select("query_id", "chunk_id")


ORACLE = """
WITH c AS (
  SELECT query_id, chunk_id, max(fused_score) AS f, max(rerank_score) AS r FROM retrieved_chunks GROUP BY 1, 2),
l AS (SELECT query_id, chunk_id, max(score) AS l FROM lexical_matches GROUP BY 1, 2),
v AS (SELECT query_id, chunk_id, max(similarity) AS v FROM vector_matches GROUP BY 1, 2),
long AS (
  UNPIVOT (SELECT * FROM c LEFT JOIN l USING (query_id, chunk_id) LEFT JOIN v USING (query_id, chunk_id))
  ON f, r, l, v INTO NAME kind VALUE x),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY x) AS place,
         count(*) OVER (PARTITION BY query_id, kind) AS n FROM long),
bounds AS (
  SELECT query_id, kind, min(x) FILTER (WHERE place >= ceil(0.1 * n)) AS lo, min(x) FILTER (WHERE place >= ceil(0.9 * n)) AS hi FROM placed GROUP BY 1, 2),
w AS (
  SELECT query_id, kind, chunk_id, least(greatest(x, lo), hi) AS w, lo, hi
  FROM long JOIN bounds USING (query_id, kind) WHERE hi > lo),
norms AS (SELECT query_id, kind, sqrt(avg((w - (lo + hi) / 2) ** 2)) AS norm FROM w GROUP BY 1, 2),
z AS (SELECT query_id, chunk_id, (w - lo) / norm AS up, (hi - w) / norm AS down FROM w JOIN norms USING (query_id, kind)),
d AS (SELECT query_id, chunk_id, sqrt(avg(up * up)) AS worst, sqrt(avg(down * down)) AS best FROM z GROUP BY 1, 2),
o AS (
  SELECT c.query_id, c.chunk_id, row_number() OVER (
    PARTITION BY c.query_id ORDER BY round(worst / nullif(worst + best, 0), 9) DESC NULLS LAST, c.chunk_id) AS position
  FROM c LEFT JOIN d USING (query_id, chunk_id))
SELECT query_id, chunk_id FROM o WHERE position <= 3
"""
