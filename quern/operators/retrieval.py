"""Lexical and dense retrieval, fusion, hydration and reranking for a batch of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.functions.text import features_of, index_terms
from quern.scope import TenantScope, deliveries
from quern.session import dealt_for_work

# Limits and constants of the search pipeline.
CANDIDATES, RRF_K, RERANK_POOL, TOP_K, MAX_TOP_K, OCCURRENCE = 50, 60, 30, 10, 50, 0.1
ANSWER_TOP_K, MAX_ANSWER_TOP_K = 8, 20
#: Vectors of one tile of a dense search; shards of a kept index.
BLOCK_ROWS, INDEX_SHARDS = 8_192, 64
#: Queries and words of one tile of a lexical search; letters that count as a word.
PART_QUERIES, BLOCK_WORDS, WORD_LETTERS = 8_192, 2_000_000, 6


def clamp_top_k(asked: int | None, default: int = TOP_K, most: int = MAX_TOP_K) -> int:
    """How many results to give; the caps of a search and of an answer differ."""
    if asked is not None and asked < 1:
        raise ValueError("top_k must be at least 1")
    return min(default if asked is None else asked, most)


def top_per(df: DataFrame, group: str, order: list[Column], limit: int | Column, name: str = "rank") -> DataFrame:
    """The first rows of each group, numbered from 1; limited before the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col(name) <= limit)


def postings(chunks: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(workspace_id, term, chunk_id, tf): the inverted index of chunks, one row each. Terms are
    counted within their chunk, so nothing is shuffled. With ``asked`` (workspace_id, term) only
    the postings of these terms are given."""
    words = chunks.select("workspace_id", "chunk_id", index_terms(F.col("content")).alias("terms"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if t.num_rows:
                flat, row = _flat(t)
                term = flat.dictionary_encode()
                most = max(len(term.dictionary), 1)
                at, tf = np.unique(row * most + term.indices.to_numpy(), return_counts=True)
                take = lambda name: t.column(name).combine_chunks().take(pa.array(at // most))
                yield pa.RecordBatch.from_arrays([take("workspace_id"), term.dictionary.take(pa.array(at % most)), take("chunk_id"), pa.array(tf)], ["workspace_id", "term", "chunk_id", "tf"])

    kinds = dict(words.dtypes)
    counted = words.mapInArrow(run, f"workspace_id {kinds['workspace_id']}, term string, chunk_id {kinds['chunk_id']}, tf long")
    return counted if asked is None else counted.join(asked.select("workspace_id", "term").distinct(), ["workspace_id", "term"], "left_semi")


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("workspace_id", "term"), F.lit(shards)).cast("int")


INDEX = "workspace_id string, term string, chunk_id string, tf long, shard int"


def save_index(index: DataFrame, path: str, shards: int = INDEX_SHARDS) -> None:
    """Keep an inverted index for later batches, in shards by workspace and term. A shard is
    sorted by both, so the row groups that a term does not touch are skipped."""
    index.withColumn("shard", _shard(shards)).repartition("shard").sortWithinPartitions("workspace_id", "term", "chunk_id").write.mode("overwrite").partitionBy("shard").parquet(path)


def load_index(spark: SparkSession, path: str, terms: DataFrame, shards: int = INDEX_SHARDS) -> DataFrame:
    """The postings of the terms asked (workspace_id, term) from a kept index; shards without any
    are not read."""
    wanted = terms.select("workspace_id", "term").distinct().withColumn("shard", _shard(shards))
    return spark.read.schema(INDEX).parquet(path).join(wanted, ["shard", "workspace_id", "term"], "left_semi").drop("shard")


def variants(queries: DataFrame) -> DataFrame:
    """(query_id, workspace_id, variants): normalised, transliterated and expanded forms."""
    forms = F.concat(F.array("normalized", "transliterated"), F.coalesce("expansions", F.array().cast("array<string>")))
    clean = F.filter(F.transform(forms, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return queries.select("query_id", "workspace_id", F.array_distinct(clean).alias("variants"))


def _asked(queries: DataFrame) -> DataFrame:
    """(query_id, workspace_id, terms): the distinct terms of all variants of each query."""
    return variants(queries).select("query_id", "workspace_id", F.array_distinct(F.flatten(F.transform("variants", lambda v: index_terms(v)))).alias("terms"))


def query_terms(queries: DataFrame) -> DataFrame:
    return _asked(queries).select("query_id", "workspace_id", F.explode("terms").alias("term"))


def ready_chunks(scope: TenantScope, *columns: str, language: str | None = None, document_id: str | None = None) -> DataFrame:
    """Chunks of ready documents with the columns named, one row each; optional filters reach the
    scan. Only what is named is read."""
    columns = tuple(dict.fromkeys(("chunk_id", *columns)))
    chunks = scope.table("chunks")
    versions = scope.ready_versions()
    if language is not None:
        chunks = chunks.where(F.col("language") == language)
    if document_id is not None:
        versions = versions.where(F.col("document_id") == document_id)
    ready = _placed(scope, versions)
    kept = chunks.join(ready, (chunks["chunk_id"] == ready["placed"]) & _same(chunks["version_id"], ready["placed_in"]), "left_semi")
    return deliveries(kept, "chunk_id", columns=columns)


def _same(a: Column, b: Column) -> Column:
    """a = b, of a form that is no key of a join: what is dealt by chunk stays where it is."""
    return F.coalesce(a == b, F.lit(False))


def _placed(scope: TenantScope, versions: DataFrame) -> DataFrame:
    """(placed, placed_in, document_id, owner): the versions that each chunk was delivered in,
    those of ``versions`` only. Narrow, so that content meets them by chunk and is moved once."""
    at = scope.table("chunks").select(F.col("chunk_id").alias("placed"), "version_id").distinct()
    return at.join(versions, "version_id").select("placed", F.col("version_id").alias("placed_in"), "document_id", F.col("workspace_id").alias("owner"))


def _tiles(q: DataFrame, v: DataFrame, q_most: int, v_most: int, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides (g, key, load and more) with pack, part and block: the tiles in which every row
    of ``q`` meets every row of ``v`` of its group g once. A part or a block holds about the load
    given at most. Small groups are packed together, as many as make up a block; large ones are
    parted. Groups of one side only are left out. ``sized`` (g, load) are rows that ``v`` is a part
    of and that cost less to read; loads are taken from them. A row a group is broadcast, so that
    neither side is moved but to its tiles."""

    def sizes(df: DataFrame, name: str, most: int) -> DataFrame:
        return df.groupBy("g").agg(F.greatest(F.lit(1), F.ceil(F.sum("load") / F.lit(most))).cast("int").alias(f"{name}s"), F.sum("load").alias(f"{name}_load"))

    counts = sizes(q, "part", q_most).join(sizes(v if sized is None else sized, "block", v_most), "g")
    lone = F.when((F.col("parts") == 1) & (F.col("blocks") == 1), F.col("part_load") + F.col("block_load"))
    total = counts.agg(F.ceil(F.coalesce(F.sum(lone), F.lit(0)) / F.lit(v_most)).cast("int").alias("full"))
    packs = F.greatest(total.scalar(), F.lit(2 * q.sparkSession.sparkContext.defaultParallelism))
    name = F.when(lone.isNull(), F.col("g")).otherwise(F.pmod(F.xxhash64("g"), packs).cast("string"))
    counts = F.broadcast(counts.select("g", "parts", "blocks", name.alias("pack")))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    rest = lambda df: [c for c in df.columns if c not in ("g", "load")]
    left = q.join(counts, "g").withColumn("part", own("parts")).withColumn("block", every("blocks")).select(F.col("pack").alias("pack"), "part", "block", F.col("g").alias("g"), *rest(q))
    right = v.join(counts, "g").withColumn("block", own("blocks")).withColumn("part", every("parts")).select(F.col("pack").alias("pack"), "part", "block", F.col("g").alias("g"), *rest(v))
    return left, right


def _flat(t: pa.Table) -> tuple[pa.Array, np.ndarray]:
    """The terms of all rows, and the row of each."""
    lists = t.column("terms").combine_chunks()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return lists.flatten(), np.repeat(np.arange(len(sizes)), sizes)


def _most_matches(a: pa.Table, b: pa.Table, limit: int) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Of queries ``a`` (g, key, terms) and chunks ``b`` (g, key, terms, tf): rows of a, rows of b
    and matching positions of the ``limit`` chunks that match each query most, ties by key. Term
    by term, the postings of a query are added up over the chunks of its group."""
    (terms, q_row), (words, v_row) = _flat(a), _flat(b)
    vocabulary = terms.unique()
    term, word = (pc.index_in(x, value_set=vocabulary) for x in (terms, words))
    known = word.is_valid().to_numpy(zero_copy_only=False)
    v_row, word = v_row[known], word.drop_null().to_numpy()
    # Chunks are numbered in the order of their keys, each with one of its rows.
    keys = b.column("key").combine_chunks().dictionary_encode(null_encoding="encode")
    chunk, first = keys.indices.to_numpy(), np.zeros(len(keys.dictionary), np.int64)
    first[chunk] = np.arange(len(chunk))
    order = pc.sort_indices(keys.dictionary, null_placement="at_start").to_numpy()
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    groups = a.column("g").combine_chunks().unique()
    q_group, v_group = (pc.fill_null(pc.index_in(t.column("g").combine_chunks(), value_set=groups), -1).to_numpy() for t in (a, b))
    here = v_group[v_row] >= 0
    v_row, word = v_row[here], word[here]
    # One posting for each group, term and chunk, in this order.
    at = (v_group[v_row].astype(np.int64) * len(vocabulary) + word) * len(order) + number[chunk[v_row]]
    by = np.argsort(at, kind="stable")
    edges = np.flatnonzero(np.diff(at[by], prepend=-1))
    tf = np.add.reduceat(b.column("tf").to_numpy()[v_row[by]], edges).astype(np.float64) if len(edges) else np.zeros(0)
    at = at[by][edges]
    place = at % max(len(order), 1)
    wanted = (q_group[q_row].astype(np.int64) * len(vocabulary) + term.to_numpy(zero_copy_only=False)) * len(order)
    low, high = np.searchsorted(at, wanted), np.searchsorted(at, wanted + len(order))
    bounds = np.searchsorted(q_row, np.arange(a.num_rows + 1))
    # Within a group the chunks are numbered from 0, so that sums stay short.
    ends = np.searchsorted(at, np.arange(len(groups) + 1, dtype=np.int64) * len(vocabulary) * len(order))
    chunks = [np.unique(place[i:j]) for i, j in zip(ends, ends[1:])]
    for c, i, j in zip(chunks, ends, ends[1:]):
        place[i:j] = np.searchsorted(c, place[i:j])
    left, right, found = [], [], []
    for row in range(a.num_rows):
        spans = [(i, j) for i, j in zip(low[bounds[row] : bounds[row + 1]].tolist(), high[bounds[row] : bounds[row + 1]].tolist()) if i < j]
        if spans:
            sums = np.bincount(np.concatenate([place[i:j] for i, j in spans]), np.concatenate([tf[i:j] for i, j in spans]))
            hits = np.flatnonzero(sums)
            if len(hits) > limit:
                n = sums[hits]
                last = np.partition(n, -limit)[-limit]
                above = hits[n > last]
                hits = np.concatenate([above, hits[n == last][: limit - len(above)]])
            left.append(np.full(len(hits), row))
            right.append(first[order[chunks[q_group[row]][hits]]])
            found.append(sums[hits].astype(np.int64))
    return left, right, found


def lexical_search(queries: DataFrame, index: DataFrame, limit: int = CANDIDATES, sized: DataFrame | None = None) -> DataFrame:
    """(query_id, chunk_id, score, rank): any term matches; the score is a tenth of the number
    of matching positions. ``index`` has postings (workspace_id, term, chunk_id, tf), or texts
    (workspace_id, chunk_id, content) whose terms are counted where they are needed. Queries meet
    the chunks of their workspace in tiles of bounded size, which give at most the best of each
    query, so no match is ever a row. ``sized``: texts among which those of the index are, for
    the sizes of tiles."""
    texts = "content" in index.columns
    words = F.coalesce(F.length("content"), F.lit(0)) / WORD_LETTERS
    terms, tf, load = (index_terms(F.col("content")), F.lit(1), words) if texts else (F.array("term"), F.col("tf"), F.lit(1))
    q = _asked(queries).where(F.size("terms") > 0).select(F.col("workspace_id").alias("g"), F.col("query_id").alias("key"), F.lit(1).alias("load"), "terms")
    v = index.where("workspace_id is not null").select(F.col("workspace_id").alias("g"), F.col("chunk_id").alias("key"), load.alias("load"), terms.alias("terms"), tf.cast("long").alias("tf"))
    kinds = dict(q.dtypes)["key"], dict(v.dtypes)["key"]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        left, right, found = _most_matches(a, b, limit) if a.num_rows and b.num_rows else ([], [], [])
        take = lambda t, n: t.column("key").combine_chunks().take(pa.array(np.concatenate([np.zeros(0, np.int64), *n])))
        return pa.table({"query_id": take(a, left), "chunk_id": take(b, right), "n": np.concatenate([np.zeros(0, np.int64), *found])})

    keys = ("pack", "part", "block")
    left, right = _tiles(q, v, PART_QUERIES, BLOCK_WORDS, None if sized is None else sized.select(F.col("workspace_id").alias("g"), words.alias("load")))
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, f"query_id {kinds[0]}, chunk_id {kinds[1]}, n long")
    scored = best.select("query_id", "chunk_id", F.round(F.col("n") * OCCURRENCE, 6).alias("score"))
    return top_per(scored, "query_id", [F.desc("score"), F.asc("chunk_id")], limit)


def _top_cells(product: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``most`` largest cells of each row, and of those that tie with the last."""
    if product.shape[1] <= most:
        return np.nonzero(np.isfinite(product))
    last = np.partition(product, -most, axis=1)[:, -most]
    return np.nonzero(product >= last[:, None] - 1e-9)


def dense_search(queries: DataFrame, vectors: DataFrame, on: list[str], limit: int = CANDIDATES, sized: DataFrame | None = None) -> DataFrame:
    """(query_id, id, similarity, rank) by exact cosine. ``queries`` has query_id and query_vec,
    ``vectors`` id and vec; ``on`` are the columns (tenant, model, version) that must agree, if
    any. Both sides are dealt into blocks of bounded size; a tile of two blocks is a matrix
    product that gives at most the best of each query, so no pair is ever a row. A tenant with
    most of the vectors has more tiles, not larger ones, and small tenants share one. Vectors that are null, all zero or of
    another length than the query's are not compared. ``sized``: rows (``on`` and vec) among which
    the vectors are, for the sizes of tiles."""
    group = F.struct(*on) if on else F.struct(F.lit(0).alias("all"))
    within = lambda vec: F.to_json(F.struct(group.alias("on"), F.size(vec).alias("width"))).alias("g")
    named = lambda df, key, vec: df.where(F.size(vec) > 0).select(within(vec), F.col(key).alias("key"), F.lit(1).alias("load"), F.col(vec).cast("array<double>").alias("v"))
    q, v = named(queries, "query_id", "query_vec"), named(vectors, "id", "vec")
    kinds = dict(q.dtypes)["key"], dict(v.dtypes)["key"]

    left, right = _tiles(q, v, BLOCK_ROWS, BLOCK_ROWS, None if sized is None else sized.where(F.size("vec") > 0).select(within("vec"), F.lit(1).alias("load")))

    def groups(t: pa.Table) -> dict[str, np.ndarray]:
        """Row numbers by group."""
        codes = t.column("g").combine_chunks().dictionary_encode()
        order = np.argsort(indices := codes.indices.to_numpy(), kind="stable")
        edges = np.searchsorted(indices[order], np.arange(len(codes.dictionary) + 1))
        return {g: order[i:j] for g, i, j in zip(codes.dictionary.to_pylist(), edges, edges[1:])}

    def units(t: pa.Table, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of one group scaled to length 1, and their numbers; those without a length left out."""
        cells = t.column("v").combine_chunks()
        offsets = cells.offsets.to_numpy()
        m = cells.values.to_numpy(zero_copy_only=False)[offsets[at][:, None] + np.arange(offsets[at[0] + 1] - offsets[at[0]])]
        norms = np.sqrt(np.einsum("ij,ij->i", m, m))
        keep = np.isfinite(norms) & (norms > 0)
        return m[keep] / norms[keep, None], at[keep]

    def tile(a: pa.Table, b: pa.Table) -> pa.Table:
        left, right, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if a.num_rows and b.num_rows:
            others = groups(b)
            for g, at in groups(a).items():
                (x, x_at), (y, y_at) = units(a, at), units(b, others[g])
                for s in range(0, len(x), 512) if len(y) else ():
                    product = x[s : s + 512] @ y.T
                    i, j = _top_cells(product, limit)
                    left.append(x_at[i + s])
                    right.append(y_at[j])
                    found.append(np.round(product[i, j], 9))
        take = lambda t, n: t.column("key").combine_chunks().take(pa.array(np.concatenate(n)))
        return pa.table({"query_id": take(a, left), "id": take(b, right), "similarity": np.concatenate(found)})

    keys = ("pack", "part", "block")
    best = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tile, f"query_id {kinds[0]}, id {kinds[1]}, similarity double")
    return top_per(best, "query_id", [F.desc("similarity"), F.asc("id")], limit)


def train_cells(vectors: DataFrame, cells: int, sample: int = 20_000, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Centres of an inverted-file index by spherical k-means over at most ``sample`` vectors, a
    stated bound; the vectors with the least hashed ids are taken."""
    rows = vectors.where(F.size("vec") > 0).orderBy(F.xxhash64("id"), "id").select("vec").limit(sample).collect()
    if not rows:
        return np.zeros((0, 0))
    m = np.array([r.vec for r in rows], dtype=np.float64)
    m = m[np.linalg.norm(m, axis=1) > 0]
    m /= np.linalg.norm(m, axis=1)[:, None]
    centres = m[np.random.default_rng(seed).permutation(len(m))[:cells]].copy()
    for _ in range(rounds):
        near = (m @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, m)
        lengths = np.linalg.norm(sums, axis=1)
        centres[lengths > 0] = sums[lengths > 0] / lengths[lengths > 0, None]
    return centres


def in_cells(df: DataFrame, vec: str, centres: np.ndarray, probes: int) -> DataFrame:
    """df with ``cell``, one row for each of the ``probes`` cells nearest to the vector. The
    centres are a fixed small matrix that goes along with the function."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                near = np.argsort(-(np.stack(pdf[vec].to_numpy()).astype(np.float64) @ centres.T), axis=1)[:, :probes]
                yield pdf.assign(cell=[[int(c) for c in row] for row in near])

    if not len(centres):  # made of no vectors
        return df.where(F.lit(False)).withColumn("cell", F.lit(0))
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
    usable = df.where(F.size(vec) == centres.shape[1])
    return usable.mapInPandas(run, schema + ", cell array<int>").withColumn("cell", F.explode("cell"))


def probed_search(queries: DataFrame, vectors: DataFrame, on: list[str], centres: np.ndarray, probes: int, limit: int = CANDIDATES) -> DataFrame:
    """dense_search within the cells nearest to each query only: approximate, and exact once all
    cells are probed. Every vector is in the index."""
    found = dense_search(in_cells(queries, "query_vec", centres, probes).withColumn("query_id", F.struct("query_id", "cell")), in_cells(vectors, "vec", centres, 1), [*on, "cell"], limit)
    return top_per(found.select("query_id.query_id", "id", "similarity"), "query_id", [F.desc("similarity"), F.asc("id")], limit)


def fuse(lists: DataFrame, k: int = RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of (query_id, source, chunk_id, rank): (query_id, chunk_id,
    fused_score, lexical_rank, dense_rank, position)."""
    if k <= 0:
        raise ValueError("k must be positive")
    rank_in = lambda s: F.min(F.when(F.col("source") == s, F.col("rank"))).alias(f"{s}_rank")
    fused = lists.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("fused_score"), rank_in("lexical"), rank_in("dense"))
    return top_per(fused, "query_id", [F.desc("fused_score"), F.asc("chunk_id")], F.lit(limit if limit is not None else 2**31 - 1), "position")


#: What a found chunk is given beside its ids.
HYDRATED = ("workspace_id", "version_id", "content", "page_number", "section", "char_start", "char_end", "language", "ocr_engine", "ocr_confidence")


def _delivered(scope: TenantScope) -> DataFrame:
    """Every chunk with what a found one is given. One plan, so that its shuffle is made once
    where it is read more than once."""
    return deliveries(scope.table("chunks"), "chunk_id", columns=HYDRATED)


def hydrate(found: DataFrame, scope: TenantScope) -> DataFrame:
    """Content and provenance joined after the limits; rows of documents that are not ready, or
    of another workspace, vanish. ``found`` is read once: it may be a whole search."""
    ready, chunks = _placed(scope, scope.ready_versions()), _delivered(scope)
    here = (chunks["chunk_id"] == ready["placed"]) & _same(chunks["version_id"], ready["placed_in"]) & _same(chunks["workspace_id"], ready["owner"])
    return found.join(chunks.join(ready, here).drop("placed", "placed_in", "owner"), "chunk_id")


def dealt_by_chunk(rows: DataFrame, spark: SparkSession) -> DataFrame:
    """rows dealt by chunk while narrow: those of one chunk are worked on together, and content
    joined to them is not moved again."""
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), "chunk_id")


def with_content(rows: DataFrame, scope: TenantScope) -> DataFrame:
    """rows with the content of their chunks, joined anew: what is ranked need not carry it."""
    return rows.join(_delivered(scope).select("chunk_id", "content"), "chunk_id")


def overlap(query: frozenset[str], passage: frozenset[str]) -> float:
    """Half coverage of the query's features, half Jaccard; 0 where either side is empty."""
    common = len(query & passage)
    return 0.5 * common / len(query) + 0.5 * common / (len(query) + len(passage) - common) if common else 0.0


#: Rerankers by name: (queries, passages) of a batch to raw scores, one each.
RERANKERS: dict[str, Callable[[list[str], list[str]], list[float]]] = {
    "lexical": lambda queries, passages: [overlap(features_of(q), features_of(p)) for q, p in zip(queries, passages)],
}


def rerank_scores(rows: DataFrame, query: str = "query", passage: str = "content", reranker: str = "lexical", tolerant: bool = False) -> DataFrame:
    """rows with raw_score, unrounded. A reranker that gives a wrong number of scores fails the
    job; one that raises fails it too, unless ``tolerant``: then its rows have null scores."""
    scored = _scoring(reranker, tolerant)
    return dealt_for_work(rows, "chunk_id", "query_id").withColumn("raw_score", scored(query, passage))


def _scoring(reranker: str, tolerant: bool) -> Callable[..., Column]:
    """The reranker as a function of the columns of the query and the passage. Only these two
    go to Python."""
    score = RERANKERS[reranker]

    @F.pandas_udf("double")
    def run(queries: pd.Series, passages: pd.Series) -> pd.Series:
        try:
            raw = score([q if isinstance(q, str) else "" for q in queries], [p if isinstance(p, str) else "" for p in passages])
        except Exception:
            if not tolerant:
                raise
            raw = [None] * len(queries)
        if len(raw) != len(queries):
            raise ValueError(f"{reranker}: {len(raw)} scores for {len(queries)} passages")
        return pd.Series(pd.array(raw, dtype="Float64"))

    return run


def _scaled(raw: str, low: Column, high: Column) -> Column:
    """Min-max, 1.0 where all are equal."""
    return F.round(F.when(high > low, (F.col(raw) - low) / (high - low)).otherwise(1.0), 9)


def normalized_scores(rows: DataFrame, group: str, raw: str, threshold: float = 0.0) -> DataFrame:
    """Min-max per group, kept from the threshold on. The bounds are aggregated and joined, so a
    large group is not gathered for them."""
    bounds = rows.groupBy(group).agg(F.min(raw).alias("lo"), F.max(raw).alias("hi"))
    return rows.join(bounds, group).withColumn("normalized_score", _scaled(raw, F.col("lo"), F.col("hi"))).drop("lo", "hi").where(F.col("normalized_score") >= threshold)


def rerank(rows: DataFrame, top_k: int | None = None, threshold: float = 0.0, reranker: str = "lexical", tolerant: bool = False) -> DataFrame:
    """Reranked rows per query with raw_score, normalized_score and rerank_rank. The rows are a
    search's pool, a bounded number per query, so its bounds are taken over a window. A query
    whose reranker failed (``tolerant``) keeps its order, with scores of 0."""
    return _reranked(rerank_scores(rows, reranker=reranker, tolerant=tolerant), top_k, threshold)


def _reranked(rows: DataFrame, top_k: int | None = None, threshold: float = 0.0) -> DataFrame:
    """rerank of rows that have their raw_score."""
    top_k = clamp_top_k(top_k)
    pool = Window.partitionBy("query_id")
    scored = rows.withColumn("_raw", F.round("raw_score", 9))
    failed = F.max(F.col("_raw").isNull()).over(pool)
    scored = scored.withColumn("_failed", failed).withColumn("normalized_score", F.when(F.col("_failed"), 0.0).otherwise(_scaled("_raw", F.min("_raw").over(pool), F.max("_raw").over(pool))))
    scored = scored.withColumn("raw_score", F.when(F.col("_failed"), 0.0).otherwise(F.col("raw_score"))).where(F.col("_failed") | (F.col("normalized_score") >= threshold))
    before = F.when(F.col("_failed"), F.col("position")) if "position" in rows.columns else F.lit(None)
    return top_per(scored, "query_id", [before.asc_nulls_last(), F.desc("normalized_score"), F.asc("chunk_id")], top_k, "rerank_rank").drop("_raw", "_failed")


def search_vectors(scope: TenantScope, language: str | None = None) -> DataFrame:
    """(workspace_id, model, model_version, id, vec) of the embeddings of ready chunks, one a key;
    vectors not as long as they are said to be are left out."""
    kept = ready_chunks(scope, "workspace_id", language=language).select("chunk_id", "workspace_id")
    rows = scope.table("chunk_embeddings").where(F.size("embedding") == F.col("dimensions"))
    # Joined before deliveries are told apart, so that vectors are moved by chunk once, for both.
    rows = rows.join(kept.withColumnRenamed("workspace_id", "owner"), "chunk_id")
    one = deliveries(rows, "chunk_id", "model", "model_version", columns=("workspace_id", "embedding", "owner"))
    return one.where("workspace_id = owner").select("workspace_id", "model", "model_version", F.col("chunk_id").alias("id"), F.col("embedding").alias("vec"))


def hybrid_search(queries: DataFrame, scope: TenantScope, query_vectors: DataFrame, top_k: int | None = None, index: DataFrame | None = None, language: str | None = None, content: bool = True) -> DataFrame:
    """The whole search as one lazy plan, for every query at once. ``query_vectors`` has query_id,
    workspace_id, model, model_version and query_vec; vectors of other models or versions are not
    compared. ``index`` is a kept inverted index; without one, the terms asked are counted.
    The pool meets each chunk's content once, for its score, and is ranked without it;
    ``content`` joins it to the results."""
    top_k = clamp_top_k(top_k)
    texts = scope.table("chunks") if index is None else None
    index = ready_chunks(scope, "workspace_id", "content", language=language) if index is None else index
    lexical = lexical_search(queries, index, sized=texts).select("query_id", "chunk_id", "rank", F.lit("lexical").alias("source"))
    dense = dense_search(query_vectors, search_vectors(scope, language), ["workspace_id", "model", "model_version"], sized=scope.table("chunk_embeddings").withColumnRenamed("embedding", "vec")).select("query_id", F.col("id").alias("chunk_id"), "rank", F.lit("dense").alias("source"))
    pool = fuse(lexical.unionByName(dense), limit=max(top_k, RERANK_POOL))
    asked = queries.select("query_id", F.col("workspace_id").alias("asked_in"), F.col("original").alias("query"))
    rows = hydrate(dealt_by_chunk(pool.join(asked, "query_id"), scope.spark), scope).where(_same(F.col("workspace_id"), F.col("asked_in"))).drop("asked_in")
    found = _reranked(rows.withColumn("raw_score", _scoring("lexical", False)("query", "content")).drop("content"), top_k)
    return with_content(found, scope) if content else found


def as_metadata(found: DataFrame) -> DataFrame:
    """(query_id, results, lexical_only, dense_only, both, best_score): what may be logged of a
    search. Counts and rounded scores, never text."""
    both = F.col("lexical_rank").isNotNull() & F.col("dense_rank").isNotNull()
    return found.groupBy("query_id").agg(
        F.count("*").alias("results"), F.count_if(F.col("dense_rank").isNull()).alias("lexical_only"), F.count_if(F.col("lexical_rank").isNull()).alias("dense_only"), F.count_if(both).alias("both"),
        F.round(F.max("fused_score"), 4).alias("best_score"),
    )
