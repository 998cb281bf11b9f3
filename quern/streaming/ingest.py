"""Micro-batch ingestion: pages arrive as files, chunks leave as replaced versions."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.operators.chunking import chunk_pages
from quern.operators.embedding import replace_versions
from quern.operators.safety import scan_documents
from quern.session import cut_lineage

PAGES = "page_id string, version_id string, page_number int, text string"


def merged_pages(batch: DataFrame, path: str) -> DataFrame:
    """All pages of the versions that a batch touches: those kept before and, over them, those of
    the batch, so a version that arrives in parts is chunked whole."""
    new = batch.dropDuplicates(["page_id"])
    try:
        old = batch.sparkSession.read.parquet(path).select(*new.columns)
    except AnalysisException:  # nothing there yet
        return new
    of_same = old.join(new.select("version_id").distinct(), "version_id", "left_semi")
    return new.unionByName(of_same.join(new.select("page_id"), "page_id", "left_anti"))


def ingest_pages(spark: SparkSession, source: str, pages_to: str, chunks_to: str, rejected_to: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Chunk and screen every version that a batch touches. Chunks of accepted versions go to
    ``chunks_to``, verdicts of quarantined ones to ``rejected_to``; both replace what was there
    for these versions, and a version quarantined now loses its chunks. So a replayed batch
    changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        pages = cut_lineage(merged_pages(batch, pages_to))
        versions = pages.select("version_id").distinct()
        chunks = cut_lineage(chunk_pages(pages))
        bad = cut_lineage(scan_documents(chunks).where("decision = 'quarantine'").select("version_id", "reason"))
        replace_versions(pages, pages_to)
        replace_versions(bad, rejected_to, versions)
        replace_versions(chunks.join(bad, "version_id", "left_anti"), chunks_to, versions)

    stream = spark.readStream.schema(PAGES).parquet(source)
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")).start()


def attempts(events: DataFrame, most: int = 3) -> DataFrame:
    """(job_id, attempts, state, error) of jobs from their event log (job_id, at, outcome, error):
    a job that succeeded or was rejected for good is done; another is queued again until it has
    failed ``most`` times. The log is only ever appended to, so any order of arrival serves."""
    last = F.max_by(F.struct("outcome", "error"), F.struct("at", "outcome")).alias("last")
    per = events.dropDuplicates(["job_id", "at", "outcome"]).groupBy("job_id").agg(F.count_if(F.col("outcome") == "started").alias("attempts"), F.count_if(F.col("outcome") == "failed").alias("failures"), last)
    state = F.when(F.col("last.outcome").isin("succeeded", "rejected"), F.col("last.outcome")).when(F.col("failures") >= most, "dead").when(F.col("last.outcome") == "started", "running").otherwise("queued")
    return per.select("job_id", "attempts", state.alias("state"), F.when(F.col("last.outcome") != "succeeded", F.col("last.error")).alias("error"))


def stale(events: DataFrame, now_seconds: float, age_seconds: float = 300.0, most: int = 3) -> DataFrame:
    """Jobs that have been running or queued without an event for too long, to be queued again."""
    idle = events.groupBy("job_id").agg(F.max(F.unix_micros("at")).alias("us"))
    waiting = attempts(events, most).where("state in ('running', 'queued')")
    return waiting.join(idle, "job_id").where(F.col("us") < F.lit(int((now_seconds - age_seconds) * 1_000_000))).select("job_id", "state", "attempts")
