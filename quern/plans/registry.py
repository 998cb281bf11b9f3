"""Queries of the engine's operators over the test tables, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from quern import model
from quern.functions import text as tx
from quern.operators import answers, chunking, citations, embedding, evaluation, query_processing, retrieval, safety
from quern.plans import pipeline, sql
from quern.scope import TenantScope, deliveries
from quern.session import dealt_for_work, shared_folder
from quern.streaming import limiter

Query = Callable[[SparkSession, str], DataFrame]


def _everyone(spark: SparkSession, sf: str) -> TenantScope:
    """Batches carry their workspace as a join key instead of binding one."""
    return TenantScope(spark, sf, everyone=True)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _queries(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "processed_queries").dropDuplicates(["query_id"])


def _chunks(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return deliveries(_t(spark, sf, "chunks"), "chunk_id", columns=columns)


def _found(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    return deliveries(_t(spark, sf, "retrieved_chunks"), "query_id", "chunk_id", columns=columns)


# ---- scope, keys, aggregates


def tenant_counts(spark, sf):
    return _t(spark, sf, "documents").groupBy("workspace_id").agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chars"), F.lit(0)).alias("chars"))


def unbound_scope(spark, sf):
    return TenantScope(spark, sf).table("documents").select("document_id", "workspace_id")


def ready_gate(spark, sf):
    return retrieval.ready_chunks(_everyone(spark, sf), "version_id")


def filtered_chunks(spark, sf):
    return retrieval.ready_chunks(_everyone(spark, sf), language="tam").select("chunk_id")


def exact_duplicates(spark, sf):
    docs = _t(spark, sf, "documents").where("text is not null").select("workspace_id", F.sha2("text", 256).alias("sha256"), "doc_id")
    return docs.groupBy("workspace_id", "sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


def latest_versions(spark, sf):
    v = _t(spark, sf, "document_versions")
    return v.groupBy("document_id").agg(F.max_by("version_id", F.struct("version_number", "version_id")).alias("version_id"), F.max("version_number").alias("version_number"))


def order_preserving_lookup(spark, sf):
    """Chunks of each query in the order they were found; missing ids vanish."""
    kept = _found(spark, sf, "fused_score").join(_chunks(spark, sf, "chunk_index"), "chunk_id")
    return retrieval.top_per(kept, "query_id", [F.desc("fused_score"), F.asc("chunk_id")], F.lit(2**31 - 1), "ord").select("query_id", "chunk_id", "chunk_index", "ord")


def broken_references(spark, sf):
    """Rows whose reference has no parent, per table."""
    parts = []
    for name, refs in model.FOREIGN.items():
        for column, parent, key in refs:
            found = model.orphans(_t(spark, sf, name), column, _t(spark, sf, parent), key)
            parts.append(found.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(column).alias("column_name"), "n"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def duplicate_keys(spark, sf):
    return model.duplicate_keys(_t(spark, sf, "chunks"), ("version_id", "chunk_index"))


def bad_values(spark, sf):
    """How many rows of each table break a check on their values."""
    checks = {
        "documents": (model.in_enum("status", "document_status"),), "pages": (model.confidence_in_range("ocr_confidence"), F.col("page_number") >= 1),
        "chunks": (model.confidence_in_range("ocr_confidence"), F.col("char_end") > F.col("char_start"), F.col("token_count") >= 1), "processed_queries": (model.confidence_in_range("confidence"), model.in_enum("language", "language")),
    }
    parts = [model.out_of_range(_t(spark, sf, n), *cs).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n, cs in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def late_rows(spark, sf):
    """Pages that were loaded more than a day after they were made."""
    return _t(spark, sf, "pages").where(F.col("loaded_at") > F.col("created_at") + F.expr("interval 1 day")).groupBy("version_id").agg(F.count("*").alias("late"))


# ---- text


def normalized_text(spark, sf):
    return _queries(spark, sf).select("query_id", tx.normalize(F.col("original")).alias("text"))


def word_tokens(spark, sf):
    return _t(spark, sf, "documents").where("text is not null").select("doc_id", tx.token_count(F.col("text")).alias("tokens"), F.size(tx.words(F.lower("text"))).alias("words"))


def trigram_features(spark, sf):
    q = _queries(spark, sf).select("query_id", F.explode(tx.feature_list(F.lower("normalized"))).alias("feature"))
    return q.groupBy("query_id").agg(F.count("*").alias("n"), F.countDistinct("feature").alias("n_distinct"), F.min("feature").alias("first_feature"), F.max("feature").alias("last_feature"))


def language_decision(spark, sf):
    d = _queries(spark, sf).withColumn("t", F.lower("normalized"))
    d = d.withColumn("d", tx.detect_language(F.col("t")))
    return d.select("query_id", F.col("d.language").alias("language"), F.round("d.confidence", 6).alias("confidence"))


def query_variants(spark, sf):
    """Forms of each query, made anew from its normalised text."""
    q = query_processing.process(_queries(spark, sf).select("query_id", F.col("normalized").alias("typed")), "typed")
    return q.select("query_id", F.col("typed").alias("normalized"), "transliterated", F.element_at(F.concat("expansions", F.array(F.lit(None).cast("string"))), 1).alias("expansion"))


def document_slugs(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", tx.slug(F.col("title")).alias("slug"), tx.email_key(F.concat(F.lit(" Clerk."), "source", F.lit("@Example.ORG "))).alias("contact"))


def language_limits(spark, sf):
    return _queries(spark, sf).select("query_id", F.array_join(tx.limitations(F.lower("normalized")), ",").alias("limitations"))


def sentence_spans(spark, sf):
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return d.select("doc_id", F.col("s.start").alias("sent_start"), F.length("s.sentence").alias("sent_length"), F.col("s.sentence").alias("sentence"))


# ---- chunking


def chunk_documents(spark, sf):
    pages = _t(spark, sf, "pages").dropDuplicates(["page_id"])
    return chunking.chunk_pages(pages).drop("content")


def chunk_provenance(spark, sf):
    """Chunks that fail a check against their page, with its code; those without a page too."""
    pages = deliveries(_t(spark, sf, "pages"), "page_id", columns=("version_id", "page_number", "text")).groupBy("version_id", "page_number").agg(F.min("text").alias("page_text"))
    c = _chunks(spark, sf, "version_id", "page_number", "content", "char_start", "char_end", "token_count", "section", "ocr_confidence").join(pages, ["version_id", "page_number"], "left")
    return c.withColumn("error", chunking.provenance_error(F.col("page_text"))).where("error is not null").select("chunk_id", "error")


# ---- retrieval


def lexical_topk(spark, sf):
    return retrieval.lexical_search(_queries(spark, sf), retrieval.ready_chunks(_everyone(spark, sf), "workspace_id", "content"), 10)


def kept_index_topk(spark, sf):
    """The same search over an index written once and read by shards."""
    q = _queries(spark, sf)
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    retrieval.save_index(retrieval.postings(retrieval.ready_chunks(_everyone(spark, sf), "workspace_id", "content")), path)
    return retrieval.lexical_search(q, retrieval.load_index(spark, path, retrieval.query_terms(q)), 10)


def _vectors(spark, sf):
    v = _t(spark, sf, "embeddings").dropDuplicates(["vec_id"])
    return v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec")), v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def dense_topk(spark, sf):
    """Every twentieth vector against all vectors."""
    return retrieval.dense_search(*_vectors(spark, sf), [], 10).withColumn("similarity", F.round("similarity", 6))


def cell_topk(spark, sf):
    """The same search within the 22 nearest of 32 cells: nine tenths are found at least. These
    vectors have no clusters, so fewer probes would lose more."""
    asked, all_of = _vectors(spark, sf)
    return retrieval.probed_search(asked, all_of, [], retrieval.train_cells(all_of, 32), 22, 10).withColumn("similarity", F.round("similarity", 6))


def embedding_counts(spark, sf):
    """Usable embeddings of ready chunks by workspace, model and version."""
    return retrieval.search_vectors(_everyone(spark, sf)).groupBy("workspace_id", "model", "model_version").agg(F.count("*").alias("n"))


def _query_vectors(spark, sf):
    """A vector for each query. The tables hold none, so a query is given the latest embedding of
    the chunk that leads its dense list."""
    lead = deliveries(_t(spark, sf, "vector_matches"), "query_id", "chunk_id", columns=("similarity",))
    lead = lead.groupBy("query_id").agg(F.max_by("chunk_id", F.struct("similarity", "chunk_id")).alias("chunk_id"))
    e = _t(spark, sf, "chunk_embeddings").where(F.size("embedding") == F.col("dimensions"))
    e = e.groupBy("chunk_id").agg(F.max(F.struct("model_version", "model", "embedding")).alias("e")).select("chunk_id", "e.*")
    q = _queries(spark, sf).select("query_id", "workspace_id")
    return q.join(lead, "query_id").join(e, "chunk_id").select("query_id", "workspace_id", "model", "model_version", F.col("embedding").alias("query_vec"))


def _ranked_lists(spark, sf):
    part = lambda name, score, source: retrieval.top_per(
        deliveries(_t(spark, sf, name), "query_id", "chunk_id", columns=(score,)), "query_id", [F.desc(score), F.asc("chunk_id")], retrieval.CANDIDATES
    ).select("query_id", "chunk_id", "rank", F.lit(source).alias("source"))
    return part("lexical_matches", "score", "lexical").unionByName(part("vector_matches", "similarity", "dense"))


def rrf_fusion(spark, sf):
    return retrieval.fuse(_ranked_lists(spark, sf)).select("query_id", "chunk_id", "fused_score", "lexical_rank", "dense_rank", "position")


def hydrated(spark, sf):
    pool = retrieval.fuse(_ranked_lists(spark, sf), limit=retrieval.RERANK_POOL)
    return retrieval.hydrate(pool, _everyone(spark, sf)).select("query_id", "chunk_id", "document_id", "version_id", "position", "page_number", "char_start", "char_end", F.length("content").alias("n_chars"))


def rerank_minmax(spark, sf):
    r = _found(spark, sf, "rerank_score").where("rerank_score is not null")
    n = retrieval.normalized_scores(r, "query_id", "rerank_score", 0.5).withColumn("normalized_score", F.round("normalized_score", 6))
    return retrieval.top_per(n, "query_id", [F.desc("normalized_score"), F.asc("chunk_id")], 10, "position").select("query_id", "chunk_id", "normalized_score", "position")


def _passages(spark, sf, *columns):
    """The six leading chunks of each query, with its text."""
    r = _found(spark, sf, "fused_score", "rerank_score", "document_id")
    r = retrieval.top_per(r, "query_id", [F.desc("fused_score"), F.asc("chunk_id")], answers.MAX_EVIDENCE)
    q = _queries(spark, sf).select("query_id", F.col("normalized").alias("query"))
    wanted = r.select("chunk_id").distinct()
    c = deliveries(_t(spark, sf, "chunks").join(wanted, "chunk_id", "left_semi"), "chunk_id", columns=("content", *columns))
    return r.join(q, "query_id").join(c, "chunk_id")


def evidence(spark, sf):
    """Passages kept as evidence: those from a floor of the fused score on, in order."""
    kept = answers.sufficient_evidence(_passages(spark, sf), floor=0.02)
    return kept.select("query_id", "chunk_id", (F.col("rank") - 1).alias("ord"), F.length("content").alias("n_chars"))


def rerank_overlap(spark, sf):
    return retrieval.rerank_scores(_passages(spark, sf)).select("query_id", "chunk_id", F.round("raw_score", 6).alias("raw_score"))


def _hybrid(spark, sf):
    return retrieval.hybrid_search(_queries(spark, sf), _everyone(spark, sf), _query_vectors(spark, sf), content=False)


def hybrid_search(spark, sf):
    """The flagship: lexical search over postings and dense search over the embeddings of ready
    chunks, fused, hydrated and reranked, for every query at once."""
    return _hybrid(spark, sf).select("query_id", "chunk_id", "document_id", F.round("fused_score", 6).alias("fused_score"), "lexical_rank", "dense_rank", F.round("raw_score", 6).alias("raw_score"), F.round("normalized_score", 6).alias("normalized_score"), "rerank_rank", "page_number")


def search_metadata(spark, sf):
    """What may be logged of each search: counts and scores, no text."""
    return retrieval.as_metadata(_hybrid(spark, sf))


def hashing_embeddings(spark, sf):
    return embedding.embed(_queries(spark, sf), "query_id", "normalized")


# ---- answers


def top_claims(spark, sf):
    return answers.best_claims(_passages(spark, sf)).select("query_id", "chunk_id", "start", "sentence", F.round("overlap", 6).alias("overlap"), "claim_index")


def newest_documents(spark, sf):
    """The hundred newest documents."""
    return _everyone(spark, sf).newest_documents(100).select("document_id", "workspace_id", F.unix_micros("created_at").alias("created_us"))


def claim_split(spark, sf):
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return d.select("doc_id", F.explode(answers.split_claims(F.col("s.sentence"))).alias("claim"))


def claim_polarity(spark, sf):
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", answers.polarity(F.col("text")).alias("p"))
    return d.select("doc_id", F.col("p.negated").alias("negated"), F.col("p.conditional").alias("conditional"), F.array_join("p.names", ",").alias("names"))


_CITED = ("version_id", "page_number", "section", "language", "char_start", "char_end", "ocr_engine", "ocr_confidence")


def _drafts(spark, sf):
    """Evidence judged, and the claims drafted from it and verified."""
    kept = answers.sufficient_evidence(_passages(spark, sf, *_CITED))
    return pipeline.ground(dealt_for_work(kept, "chunk_id", "query_id"))


def verified_claims(spark, sf):
    _, checked = _drafts(spark, sf)
    return checked.select("query_id", "chunk_id", "claim_index", "verdict", F.round("coverage", 6).alias("coverage"), "reason", "confidence")


def composed_answers(spark, sf):
    kept, checked = _drafts(spark, sf)
    return answers.compose(_queries(spark, sf), checked, kept)


def answer_claims(spark, sf):
    """The claims that answers show, renumbered, with the place of their quote."""
    _, checked = _drafts(spark, sf)
    return answers.surfaced(checked).select("query_id", "claim_index", "chunk_id", "start", F.length("sentence").alias("n_chars"), "confidence")


def full_answers(spark, sf):
    """Whole answers: decision, text, claims and their citations."""
    kept, checked = _drafts(spark, sf)
    return answers.to_answers(answers.compose(_queries(spark, sf), checked, kept), answers.surfaced(checked))


def grounded_answers(spark, sf):
    """Answers from the search itself: every query searched, grounded and decided upon."""
    out = pipeline.answer_queries(_queries(spark, sf), _everyone(spark, sf), _query_vectors(spark, sf))
    return out.select("query_id", "decision", "status", "evidence", "supported", "dropped", "confidence", F.transform("claims", lambda c: c["citation"]["chunk_id"]).alias("cited"))


def claim_confidence(spark, sf):
    """Confidence of the six leading passages of each query, each taken whole."""
    conf = answers.claim_confidence(F.col("fused_score"), F.col("rerank_score"), answers.query_overlap(F.col("query"), F.col("content")), F.col("ocr_engine"), F.col("ocr_confidence"))
    return _passages(spark, sf, "ocr_engine", "ocr_confidence").select("query_id", "chunk_id", conf.alias("confidence"))


def citation_resolve(spark, sf):
    """Quotes from within each found chunk, some of them off."""
    r = _found(spark, sf, "workspace_id", "document_version_id", "lexical_rank")
    c = _chunks(spark, sf, "content")
    third, size = F.floor(F.length("content") / 3).cast("int"), F.floor(F.length("content") / 4).cast("int") + 1
    rank = F.coalesce("lexical_rank", F.lit(0))
    q = r.join(c, "chunk_id").select(
        F.concat_ws("/", "query_id", "chunk_id").alias("ref_id"), "workspace_id", F.col("document_version_id").alias("version_id"), "chunk_id", third.alias("quote_start"),
        F.when(rank == 2, F.lit(100000)).otherwise(third + size).alias("quote_end"), F.when(rank == 3, F.lit("not there")).otherwise(F.substring("content", third + 1, size)).alias("quote"),
    )
    return citations.resolve(q, _everyone(spark, sf))


def citation_sentences(spark, sf):
    """The claims of each query as quotes: whole sentences at their own offsets."""
    r = _found(spark, sf, "workspace_id", "document_version_id").withColumnRenamed("document_version_id", "version_id")
    claims = answers.best_claims(_passages(spark, sf)).select("query_id", "chunk_id", F.col("start").alias("quote_start"), (F.col("start") + F.length("sentence")).alias("quote_end"), F.col("sentence").alias("quote"))
    q = claims.join(r, ["query_id", "chunk_id"]).withColumn("ref_id", F.concat_ws("/", "query_id", "chunk_id")).drop("query_id")
    return citations.resolve(q, _everyone(spark, sf))


# ---- safety


def injection_signals(spark, sf):
    """Every finding in every chunk, with its place and an excerpt."""
    a = safety.assess(_chunks(spark, sf, "content"), "content")
    return a.select("chunk_id", F.inline("signals"))


def injection_rules_hits(spark, sf):
    """Matches of each rule in document texts, a sentence planted in each by turns."""
    planted = F.element_at(F.array(*map(F.lit, sql.PLANTED)), (F.col("doc_id") % len(sql.PLANTED) + 1).cast("int"))
    d = _t(spark, sf, "documents").where("text is not null").select("doc_id", F.concat_ws("\n", "text", planted).alias("text"))
    rules = [name for name, *_ in safety.RULES]
    found = safety.assess(d, "text").select("doc_id", F.explode("signals.rule").alias("rule")).where(F.col("rule").isin(rules))
    return found.groupBy("doc_id", "rule").agg(F.count("*").alias("hits"))


def invisible_characters(spark, sf):
    n = F.length("content") - F.length(F.translate("content", safety.INVISIBLE, ""))
    return _chunks(spark, sf, "content").select("chunk_id", n.alias("n")).where("n > 0")


def document_safety(spark, sf):
    return safety.scan_documents(_chunks(spark, sf, "version_id", "chunk_index", "content"))


# ---- streaming, evaluation


def rate_limit(spark, sf):
    e = _t(spark, sf, "events").select(F.col("user_id").cast("string").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.xxhash64("event_type", "value").alias("tie"))
    timed = e.withColumn("at", F.col("us") / 1e6)
    return limiter.admit_batch(timed, "user_id", "at", "tie", 3, 86_400.0).groupBy("user_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("rejected"))


def eval_ranking(spark, sf):
    """The fused order measured against the reranker's first three."""
    r = _found(spark, sf, "rerank_rank", "fused_score").where("rerank_rank is not null")
    ranked = retrieval.top_per(r, "query_id", [F.desc("fused_score"), F.asc("chunk_id")], F.lit(2**31 - 1), "position")
    return evaluation.ranking_metrics(ranked, F.col("rerank_rank") <= 3, 3, 10)


def eval_language(spark, sf):
    """Whether a query is romanised Tamil, decided by rule and measured against its label."""
    q = _queries(spark, sf).withColumn("guess", tx.detect_language(F.lower("normalized"))["language"]).withColumn("kind", F.when(F.length("normalized") < 40, "short").otherwise("long"))
    return evaluation.decision_metrics(q, F.col("language") == "tanglish", F.col("guess") == "tanglish", "kind")


_ALL: tuple[Query, ...] = (
    tenant_counts, unbound_scope, ready_gate, filtered_chunks, exact_duplicates, latest_versions, order_preserving_lookup, broken_references, duplicate_keys, bad_values, late_rows, normalized_text, word_tokens,
    trigram_features, language_decision, query_variants, document_slugs, language_limits, sentence_spans, chunk_documents, chunk_provenance, lexical_topk, kept_index_topk, dense_topk, cell_topk, embedding_counts, rrf_fusion, hydrated, rerank_minmax, rerank_overlap, hybrid_search, search_metadata, evidence, newest_documents,
    hashing_embeddings, top_claims, claim_split, claim_polarity, verified_claims, composed_answers, answer_claims, full_answers, grounded_answers, claim_confidence, citation_resolve, citation_sentences, injection_signals, injection_rules_hits, invisible_characters,
    document_safety, rate_limit, eval_ranking, eval_language,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return sql.oracles()
