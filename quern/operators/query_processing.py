"""From a query as it was typed to the forms under which it is searched."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from quern.functions import text as tx

Rewriter = Callable[[Column], Column]


def process(queries: DataFrame, text: str, spelling: Rewriter = tx.fold_spelling, transliterator: Rewriter = tx.transliterate) -> DataFrame:
    """queries with original, normalized, transliterated, expansions, language, confidence and
    limitations. Only romanised Tamil is folded and transliterated; for others that would add
    noise. The folded form is an expansion only where folding changed anything."""
    q = queries.withColumn("original", F.col(text)).withColumn("normalized", tx.normalize(F.col(text)))
    q = q.withColumn("_d", tx.detect_language(F.lower("normalized"))).withColumn("_roman", F.col("_d.language") == "tanglish")
    q = q.withColumn("_folded", F.when(F.col("_roman"), spelling(F.col("normalized"))).otherwise(F.col("normalized")))
    expansions = F.when(F.col("_folded") != F.col("normalized"), F.array("_folded")).otherwise(F.array().cast("array<string>"))
    q = q.withColumn("transliterated", F.when(F.col("_roman"), transliterator(F.col("_folded"))).otherwise(F.col("normalized"))).withColumn("expansions", expansions)
    q = q.withColumn("language", F.col("_d.language")).withColumn("confidence", F.round("_d.confidence", 6)).withColumn("limitations", tx.limitations(F.lower("normalized")))
    return q.drop("_d", "_roman", "_folded")


def view() -> Column:
    """A processed query as JSON, its confidence to four digits."""
    return F.to_json(F.struct("original", "normalized", "transliterated", F.struct("language", F.round("confidence", 4).alias("confidence"), "limitations").alias("detection"), "expansions"))
