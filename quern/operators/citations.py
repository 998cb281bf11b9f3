"""Resolving cited quotes to their chunks, pages and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quern.scope import TenantScope, deliveries


def reliability(engine: Column, confidence: Column) -> Column:
    """1 for text that was never read by OCR, null for OCR of unknown confidence."""
    return F.when(engine.isNull(), F.lit(1.0)).when(confidence.isNull(), None).otherwise(F.least(F.greatest(confidence, F.lit(0.0)), F.lit(1.0)))


def resolve(references: DataFrame, scope: TenantScope) -> DataFrame:
    """references (ref_id, workspace_id, version_id, chunk_id, quote_start, quote_end, quote) with
    error, document_id, page_number, page_quote_start, page_quote_end and reliability. What is
    missing, foreign, not ready or of another version gets one and the same code."""
    cited = references.select("chunk_id").distinct()
    chunks = deliveries(scope.table("chunks").join(cited, "chunk_id", "left_semi"), "chunk_id", columns=("workspace_id", "version_id", "content", "page_number", "char_start", "ocr_engine", "ocr_confidence"))
    ready = scope.ready_versions().select("version_id", "document_id", "workspace_id")
    known = chunks.join(ready, ["version_id", "workspace_id"]).withColumn("found", F.lit(True))
    joined = references.join(known, ["workspace_id", "version_id", "chunk_id"], "left")
    a, b = F.col("quote_start"), F.col("quote_end")
    inside = (a >= 0) & (a < b) & (b <= F.length("content"))
    error = (
        F.when(F.col("found").isNull(), "NOT_FOUND")
        .when(~F.coalesce(inside, F.lit(False)), "OUT_OF_RANGE")
        .when(~F.coalesce(F.substring(F.col("content"), a + 1, b - a) == F.col("quote"), F.lit(False)), "QUOTE_MISMATCH")
    )
    ok = error.isNull()
    return joined.select(
        "ref_id", error.alias("error"), F.when(ok, F.col("document_id")).alias("document_id"), F.when(ok, F.col("page_number")).alias("page_number"),
        F.when(ok, F.col("char_start") + a).alias("page_quote_start"), F.when(ok, F.col("char_start") + b).alias("page_quote_end"),
        F.when(ok, F.round(reliability(F.col("ocr_engine"), F.col("ocr_confidence")), 6)).alias("reliability"),
    )
