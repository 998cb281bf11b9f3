"""From queries to grounded answers: search, evidence, claims, verification, decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quern.operators import answers, retrieval
from quern.scope import TenantScope
from quern.session import cut_lineage


def ground(kept: DataFrame, analyser: str = "lexical") -> tuple[DataFrame, DataFrame]:
    """(evidence judged, claims drafted from it and verified). ``kept`` are the passages kept as
    evidence, with query_id, query, chunk_id, content, rank, fused_score, rerank_score and the
    columns of a citation. The raw score of the reranker counts, not its rank among the others."""
    judged = cut_lineage(answers.judged_passages(kept, analyser))  # read for counts and claims; without content
    sure = answers.claim_confidence(F.col("fused_score"), F.col("rerank_score"), answers.query_overlap(F.col("query"), F.col("sentence")), F.col("ocr_engine"), F.col("ocr_confidence"))
    return judged, cut_lineage(answers.with_confidence(answers.leading_claims(judged), sure))


def answer_queries(
    queries: DataFrame, scope: TenantScope, query_vectors: DataFrame, top_k: int | None = None, floor: float = answers.EVIDENCE_FLOOR, most: int = answers.MAX_EVIDENCE, language: str | None = None, index: DataFrame | None = None
) -> DataFrame:
    """One answer for every query of the batch, with its claims and their citations, or with the
    reason why it was withheld. A query whose workspace shows it nothing is answered like one
    without evidence."""
    top_k = retrieval.clamp_top_k(top_k, retrieval.ANSWER_TOP_K, retrieval.MAX_ANSWER_TOP_K)
    found = retrieval.hybrid_search(queries, scope, query_vectors, top_k, index, language, content=False)
    passages = found.withColumn("rank", F.col("rerank_rank")).withColumn("rerank_score", F.col("raw_score"))
    few = answers.sufficient_evidence(passages, floor, most)  # before content is joined
    judged, checked = ground(retrieval.with_content(retrieval.dealt_by_chunk(few, scope.spark), scope))
    return answers.to_answers(answers.compose(queries, checked, judged), answers.surfaced(checked))
