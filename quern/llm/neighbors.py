"""Most similar vectors by a block matrix join (problem 3).

Unit vectors are quantised to int8 with one scale each; the length of what rounding lost is
kept beside them. Rows are dealt by hash into blocks of bounded size, and every tile (a pair of
blocks) is one task: the int8 codes are multiplied as matrices (in float32, those of one side with
their scales), and with the stored losses e each product bounds the cosine:

    |x.y - s_x s_y q_x.q_y|  <=  e_x |y'| + e_y |x'| + e_x e_y

Pairs whose upper bound reaches the threshold survive, are joined back to the float vectors and
recomputed in double. For the k nearest, a tile goes through its block strip by strip and carries
the k + 1 greatest products of each query so far; what can still belong to them, by the bounds,
survives and is recomputed in double from the float vectors, which travel along. The best of
each tile are merged by Spark, limited before and after the shuffle. Bounds are strict, so
nothing is lost: recall is 1. For pairs a row travels as 64 bytes of codes, its key and two
floats, once per tile of its block; a group with most of the rows has more blocks, not larger
tasks. Work is quadratic in the size of a group, as the method is.

Results: vectors that are null, of the wrong length, all zero or not finite are left out.
Re-delivered rows count once. Identical vectors have cosine 1 and are reported as any pair; for
the k nearest, ties go by key. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from quern.llm.common import checkpointed, table

BLOCK_ROWS = 16_384
#: Rows of a product in a search for pairs: small enough to stay in a core's cache.
SUB_ROWS = 512
#: Queries and rows multiplied at once in a search for the nearest; cells of a strip whose maximum
#: bounds it.
ASKED_ROWS, NEAR_ROWS, STRIP = 256, 4_096, 32
#: float32 rounding of scales and losses, far above its true size.
SLACK = 1e-5


PREPARED = "codes binary, scale float, loss float, unit binary"


def _cells(rows: np.ndarray) -> pa.Array:
    """A binary cell for the bytes of each row."""
    width = rows.shape[1] * rows.itemsize
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def _rows(cells: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """The rows that binary cells of one size hold, without a Python object for each."""
    whole = cells.combine_chunks() if isinstance(cells, pa.ChunkedArray) else cells
    if not pa.types.is_binary(whole.type) or whole.null_count or not len(whole):
        return np.frombuffer(b"".join(whole.to_pylist()), dtype=kind).reshape(len(whole), -1 if len(whole) else 0)
    offsets = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1]
    return np.frombuffer(whole.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(kind).reshape(len(whole), -1)


def unit_vectors(df: DataFrame, key: str, vector: str, group: list[str], width: Column | None = None, floats: bool = False) -> DataFrame:
    """(key, g, codes, scale, loss, unit): one row per key with a usable vector. ``unit`` is the
    vector scaled to length 1, as float64 bytes; codes are its int8 values; loss is the length
    of what their rounding lost. With ``floats``, ``unit`` is a float vector as it came: half
    the bytes, nothing lost."""
    usable = F.col(vector).isNotNull() & (F.size(vector) == (width if width is not None else F.size(vector))) & (F.size(vector) > 0)
    rows = df.where(usable & F.col(key).isNotNull()).select(F.col(key).alias("key"), F.struct(F.size(vector).alias("width"), *group).alias("g"), F.col(vector).alias("v"))
    kinds = dict(rows.dtypes)
    single = floats and kinds["v"] == "array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(2)
            flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            offsets = cells.offsets.to_numpy()
            starts, sizes = offsets[:-1] - (offsets[0] if len(offsets) else 0), np.diff(offsets)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                v = flat[starts[at][:, None] + np.arange(size)]
                length = np.sqrt(np.einsum("ij,ij->i", v, v))
                keep = np.isfinite(length) & (length > 0)
                v, at = v[keep], pa.array(at[keep])
                x = v / length[keep, None]
                scale = np.abs(x).max(axis=1) / 127
                q = np.rint(x / scale[:, None])
                loss = np.sqrt(np.square(x - q * scale[:, None]).sum(axis=1)) + SLACK
                unit = v.astype(np.float32) if single else x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), _cells(q.astype(np.int8)), pa.array(scale.astype(np.float32)), pa.array(loss.astype(np.float32)), _cells(unit)],
                    ["key", "g", "codes", "scale", "loss", "unit"],
                )

    return checkpointed(rows.mapInArrow(run, f"key {kinds['key']}, g {kinds['g']}, {PREPARED}").dropDuplicates(["key"]))


def with_cosine(pairs: DataFrame, x_side: DataFrame, y_side: DataFrame) -> DataFrame:
    """pairs (x, y) with their cosine, recomputed in double."""
    x = x_side.select(F.col("key").alias("x"), F.col("unit").alias("ux"))
    y = y_side.select(F.col("key").alias("y"), F.col("unit").alias("uy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.binary_length(batch.column(2)).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = batch.take(pa.array(np.flatnonzero(sizes == size)))
                dots = np.einsum("ij,ij->i", _rows(part.column(2), np.float64), _rows(part.column(3), np.float64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(dots)], ["x", "y", "similarity"])

    kind = dict(pairs.dtypes)["x"]
    return pairs.join(x, "x").join(y, "y").select("x", "y", "ux", "uy").mapInArrow(run, f"x {kind}, y {kind}, similarity double")


class _Side:
    """One side of a tile. ``scaled`` holds the codes with their scales, a column a row."""

    def __init__(self, keys: pa.Array | np.ndarray, q: np.ndarray, scale: np.ndarray, loss: np.ndarray):
        self.keys, self.q, self.scale, self.loss = keys, q, scale, loss
        self.scaled = np.ascontiguousarray((q * scale[:, None]).T)

    @classmethod
    def of(cls, t: pa.Table) -> _Side:
        return cls(t.column("key").combine_chunks(), _rows(t.column("codes"), np.int8).astype(np.float32), t.column("scale").to_numpy(), t.column("loss").to_numpy())

    def __len__(self) -> int:
        return len(self.keys)


def _slack(a: _Side, b: _Side) -> float:
    """Bound of the error over a whole tile: |x'| <= 1 + e; and the rounding of float32 sums."""
    ea, eb = float(a.loss.max()), float(b.loss.max())
    return ea * (1 + eb) + eb * (1 + ea) + ea * eb + (a.q.shape[1] + 8) * 2.0**-23


def _block_counts(units: DataFrame, per: int) -> DataFrame:
    return units.groupBy("g").agg(F.ceil(F.count("*") / F.lit(per)).cast("int").alias("blocks"))


def _with_blocks(units: DataFrame) -> DataFrame:
    """The codes with the number of blocks of their group, and their block."""
    return units.drop("unit").join(_block_counts(units, BLOCK_ROWS), "g").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))


def _by_tile(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by tile into a stated number of partitions: a tile is little data and much
    work, so adaptive execution must not join them."""
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def similar_pairs(units: DataFrame, threshold: float) -> DataFrame:
    """(id_a, id_b, similarity) of all pairs within a group whose cosine reaches the threshold,
    id_a < id_b."""
    rows = _with_blocks(units)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tiles = rows.withColumn("other", other).select("key", "g", "codes", "scale", "loss", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def tile(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(batches)
        i, j = key[1].as_py(), key[2].as_py()
        block = t.column("block").to_numpy()
        a = _Side.of(t.filter(pa.array(block == i)))
        b = a if i == j else _Side.of(t.filter(pa.array(block == j)))
        if not len(a) or not len(b):
            return
        floor = ((threshold - _slack(a, b)) / a.scale)[:, None]
        for s in range(0, len(a), SUB_ROWS):
            part = a.q[s : s + SUB_ROWS]
            for c in range(s if a is b else 0, len(b), SUB_ROWS):
                near = part @ b.scaled[:, c : c + SUB_ROWS] >= floor[s : s + SUB_ROWS]
                if not near.any():
                    continue
                x, y = np.nonzero(near)
                x, y = x + s, y + c
                if a is b:
                    x, y = x[x < y], y[x < y]
                if len(x):
                    yield pa.RecordBatch.from_arrays([a.keys.take(pa.array(x)), b.keys.take(pa.array(y))], ["x", "y"])

    kind = dict(units.dtypes)["key"]
    found = _by_tile(tiles, "g", "i", "j").groupBy("g", "i", "j").applyInArrow(tile, f"x {kind}, y {kind}")
    exact = with_cosine(found, units, units)
    return exact.where(F.col("similarity") >= threshold).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"), "similarity")


def _float_units(cells: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of length 1 in double, from float64 or float32 bytes."""
    v = _rows(cells, np.float64 if len(cells[0].as_py()) == 8 * width else np.float32).astype(np.float64)
    return v / np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]


def _candidates(asked: np.ndarray, rows: _Side, slack: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) of all cells that may be among the ``most`` nearest of their query. ``asked``
    are codes; their scales are left out of the products and divided out of the slack.

    The ``most`` greatest products are carried along; of each strip of cells only the maximum is
    taken for them (still different cells, and fewer), and only strips whose maximum can reach
    them are looked into."""
    count = len(asked)
    best = np.full((count, most), -np.inf, np.float32)
    x, y, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]
    for c in range(0, len(rows), NEAR_ROWS):
        product = asked @ rows.scaled[:, c : c + NEAR_ROWS]
        strips = product.shape[1] // STRIP
        whole = strips * STRIP
        cells, rest = product[:, :whole].reshape(count, STRIP, strips), product[:, whole:]
        tops = cells.max(axis=1)
        both = np.concatenate([best, tops, rest], axis=1)
        best = np.partition(both, both.shape[1] - most, axis=1)[:, -most:]
        floor = best.min(axis=1) - 2 * slack  # either may be off by the slack
        at, strip = np.nonzero(tops >= floor[:, None])
        hit, depth = np.nonzero((values := cells[at, :, strip]) >= floor[at][:, None])
        x.append(at[hit])
        y.append(depth * strips + strip[hit] + c)
        found.append(values[hit, depth])
        at, to = np.nonzero(rest >= floor[:, None])
        x.append(at)
        y.append(to + whole + c)
        found.append(rest[at, to])
    x, y, found = map(np.concatenate, (x, y, found))
    keep = found >= (best.min(axis=1) - 2 * slack)[x]  # against what came later, too
    return x[keep], y[keep]


def nearest(queries: DataFrame, units: DataFrame, k: int) -> DataFrame:
    """(query_id, neighbor_id, similarity, position): the k most similar rows of each query's
    group, the query itself excluded. ``queries`` are rows of the form of ``units``."""
    per = 2 * BLOCK_ROWS
    prepared = ["codes", "scale", "loss", "unit"]
    columns = ["g", "block", "part", "key", *prepared]
    counts = _block_counts(units, per)
    rows = units.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    asked = queries.join(counts, "g").join(_block_counts(queries, per).withColumnRenamed("blocks", "parts"), "g").withColumn("part", F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts")).cast("int"))
    # Queries go to every block of their group; a tile holds one block and one part of the queries.
    q_side = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(*columns, F.lit(True).alias("asks"))
    r_side = rows.join(asked.select("g", "part").distinct(), "g").select(*columns, F.lit(False).alias("asks"))

    def tile(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        asks = t.column("asks").to_numpy()
        a, b = t.filter(pa.array(asks)), t.filter(pa.array(~asks))
        left, right, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(a) and len(b):
            width = key[0].as_py()["width"]
            u, v = _float_units(a.column("unit"), width), _float_units(b.column("unit"), width)
            x_side, y_side = _Side.of(a), _Side.of(b)
            slack = _slack(x_side, y_side) / x_side.scale
            at = {x: n for n, x in enumerate(b.column("key").to_pylist())}
            own = np.array([at.get(x, -1) for x in a.column("key").to_pylist()])
            for s in range(0, len(a), ASKED_ROWS):
                x, y = _candidates(x_side.q[s : s + ASKED_ROWS], y_side, slack[s : s + ASKED_ROWS], k + 1)  # one more: the query itself
                x = x + s
                other = y != own[x]
                x, y = x[other], y[other]
                exact = np.einsum("ij,ij->i", u[x], v[y])
                order = np.lexsort((-exact, x))
                x, y, exact = x[order], y[order], exact[order]
                first = np.searchsorted(x, x)  # of the rows of the same query
                kth = exact[np.minimum(first + k, np.searchsorted(x, x, "right")) - 1]
                near = exact >= kth - 2e-9  # rounding may tie what lies closer
                left.append(x[near])
                right.append(y[near])
                found.append(exact[near])
        take = lambda side, n: side.column("key").combine_chunks().take(pa.array(np.concatenate(n)))
        return pa.table({"x": take(a, left), "y": take(b, right), "similarity": np.concatenate(found)})

    kind = dict(units.dtypes)["key"]
    best = _by_tile(q_side.unionByName(r_side), "g", "block", "part").groupBy("g", "block", "part").applyInArrow(tile, f"x {kind}, y {kind}, similarity double")
    rank = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("similarity"), "y"))
    ranked = best.withColumn("similarity", F.round("similarity", 9)).withColumn("position", rank).where(F.col("position") <= k)
    return ranked.select(F.col("x").alias("query_id"), F.col("y").alias("neighbor_id"), "similarity", "position")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = unit_vectors(table(spark, sf_dir, "chunk_embeddings"), "embedding_id", "embedding", ["model", "model_version"], F.col("dimensions"))
    return similar_pairs(units, 0.90).select("id_a", "id_b")


def p3_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 20, against all vectors."""
    units = unit_vectors(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", [])
    return nearest(units.where(F.col("key") % 20 == 0), units, 5).withColumn("similarity", F.round("similarity", 6))


def p3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every chunk embedding among those of its model and version."""
    units = unit_vectors(table(spark, sf_dir, "chunk_embeddings"), "embedding_id", "embedding", ["model", "model_version"], F.col("dimensions"), floats=True)
    return nearest(units, units, 5).withColumn("similarity", F.round("similarity", 6))


ORACLE_FOUND = """
WITH e AS (
  SELECT embedding_id, any_value(model) AS m, any_value(model_version) AS mv, any_value(embedding::DOUBLE[]) AS v
  FROM chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = dimensions GROUP BY embedding_id),
u AS (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM e WHERE list_dot_product(v, v) > 0)
SELECT a.embedding_id AS id_a, b.embedding_id AS id_b
FROM u a JOIN u b ON a.m = b.m AND a.mv = b.mv AND a.embedding_id < b.embedding_id
WHERE list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.90
"""

ORACLE_KNN = """
WITH u AS (SELECT vec_id, any_value(embedding::DOUBLE[]) AS v FROM embeddings WHERE list_dot_product(embedding, embedding) > 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id, round(list_cosine_similarity(q.v, n.v), 9) AS sim
  FROM u q JOIN u n ON q.vec_id % 20 = 0 AND q.vec_id <> n.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS position FROM s)
SELECT query_id, neighbor_id, round(sim, 6) AS similarity, position::INT AS position FROM r WHERE position <= 5
"""

ORACLE_NEAREST = """
WITH e AS (
  SELECT embedding_id, any_value(model) AS m, any_value(model_version) AS mv, any_value(embedding::DOUBLE[]) AS v
  FROM chunk_embeddings WHERE embedding IS NOT NULL AND len(embedding) = dimensions GROUP BY embedding_id),
u AS (SELECT * FROM e WHERE list_dot_product(v, v) > 0),
s AS (
  SELECT q.embedding_id AS query_id, n.embedding_id AS neighbor_id, round(list_cosine_similarity(q.v, n.v), 9) AS sim
  FROM u q JOIN u n ON q.m = n.m AND q.mv = n.mv AND q.embedding_id <> n.embedding_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, neighbor_id) AS position FROM s)
SELECT query_id, neighbor_id, round(sim, 6) AS similarity, position::INT AS position FROM r WHERE position <= 5
"""
