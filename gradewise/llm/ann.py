"""Nearest neighbours by randomly rotated one-bit codes.

Vectors are centred, rotated by a fixed random rotation and kept as one sign bit a dimension beside two scalars: the
length, and the inner product of the unit vector with its code's direction. A query's inner product with a code,
divided by that product, estimates the inner product with the vector; its error is within ``EPSILON`` / sqrt(dim - 1)
times sqrt(1 - product^2) / product but for a vanishing share of pairs. Distance bounds follow. In each block the
vectors with the best estimates are measured first, on the originals; then only those whose lower bound is within the
k-th best distance found. Codes, scalars and originals of a block are shuffled together, originals as 32-bit floats where
that loses nothing, so nothing is joined back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from gradewise.llm.store import materialize

#: How far an estimate may be off, in standard deviations of a rotated code's error.
EPSILON = 3.0
#: Queries and vectors that one task holds at a time.
QUERY_BLOCK, VECTOR_BLOCK = 1024, 8192
SEED = 20240501


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.RandomState(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode(vectors: np.ndarray, center: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of unit vectors with their codes' directions."""
    dim = vectors.shape[1]
    x = (vectors - center) @ turn.T
    length = np.linalg.norm(x, axis=1)
    bits = x > 0
    product = np.abs(x).sum(axis=1) / np.sqrt(dim) / np.where(length > 0, length, 1)
    return np.packbits(bits, axis=1), length, np.where(length > 0, product, 1.0)


def signs_of(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def bounds(query: np.ndarray, signs: np.ndarray, length: np.ndarray, product: np.ndarray, center: np.ndarray, turn: np.ndarray, epsilon: float = EPSILON) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of squared distances from ``query`` to the coded vectors."""
    dim = len(query)
    q = turn @ (query - center)
    size = np.linalg.norm(q)
    unit = (signs @ (q / (size or 1)).astype(np.float32)).astype(np.float64) / np.sqrt(dim)
    guess = unit / product
    error = epsilon * np.sqrt(np.maximum(1 - product**2, 0)) / product / np.sqrt(max(1, dim - 1)) + 1e-6
    base = length**2 + size**2
    low = base - 2 * length * size * np.minimum(1, guess + error)
    high = base - 2 * length * size * np.maximum(-1, guess - error)
    return low, high


def packed(vector: np.ndarray) -> bytes:
    """Bytes of a vector of doubles: 32-bit floats where they hold it exactly."""
    small = vector.astype("<f4")
    return small.tobytes() if (small == vector).all() else vector.astype("<f8").tobytes()


def unpacked(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f4" if len(raw) == 4 * dim else "<f8").astype(np.float64)


def distances(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of ``x`` from ``q``, squares summed in the order of the components."""
    total = np.zeros(len(x))
    for j in range(len(q)):
        total += (x[:, j] - q[j]) ** 2
    return np.sqrt(total)


def _coder(dim: int, center: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            codes, length, product = encode(x, center, turn)
            raw = pa.array([packed(v) for v in x], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), raw, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(length), pa.array(product)], names=["vec_id", "raw", "code", "length", "product"])

    return run


def _searcher(dim: int, center: np.ndarray, k: int):
    """Rows of one (query block, vector block) follow one another; queries come first."""

    def best(queries: list, vectors: list, turn: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not queries or not vectors:
            return
        ids = np.array([v[0] for v in vectors])
        x = np.stack([unpacked(v[1], dim) for v in vectors])
        signs = signs_of(np.frombuffer(b"".join(v[2] for v in vectors), dtype=np.uint8).reshape(len(vectors), -1), dim)
        length, product = np.array([v[3] for v in vectors]), np.array([v[4] for v in vectors])
        found = []
        for qid, raw in queries:
            q = unpacked(raw, dim)
            low, high = bounds(q, signs, length, product, center, turn)
            low[ids == qid] = np.inf
            high[ids == qid] = np.inf
            if len(ids) > 4 * k:
                first = np.argpartition(low + high, 4 * k)[: 4 * k]
                reach = np.partition(np.where(ids[first] == qid, np.inf, distances(x[first], q)), k - 1)[k - 1] ** 2
            else:
                reach = np.inf
            pick = np.flatnonzero((low <= reach * (1 + 1e-9)) & (ids != qid))
            exact = distances(x[pick], q)
            found += [(qid, int(ids[pick[j]]), float(exact[j])) for j in np.lexsort((ids[pick], exact))[:k]]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotation(dim)
        key, queries, vectors = None, [], []
        for batch in batches:
            for qb, vb, is_vector, vec_id, raw, code, length, product in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (qb, vb) != key:
                    yield from best(queries, vectors, turn)
                    key, queries, vectors = (qb, vb), [], []
                if is_vector:
                    vectors.append((vec_id, raw, code, length, product))
                else:
                    queries.append((vec_id, raw))
        yield from best(queries, vectors, turn)

    return run


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, vector`` of rows that take part: known id, not null, not empty, no null or non-finite part, not zero."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0))


def nearest(vectors: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row whose id is divisible by ``every`` its ``k`` nearest other rows.

    ``score`` is the Euclidean distance of the original vectors in double precision; ties go to the smaller id. Rows
    that ``usable`` leaves out are neither queries nor found. Every other row can be found, rows that repeat an id each
    for itself; such an id asks once, with the vector whose bytes sort first, and never finds its own rows. Vectors of
    another dimension than the commonest (of ties the smallest) take no part. Other columns are not read. An empty table
    gives no rows. Queries and vectors are dealt into blocks and each pair of blocks meets once.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, id_col, vector_col)
    dims = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (dims["dim"], dims["n"]) if dims else (1, 0)
    rows = rows.where(F.size("vector") == dim)
    means = rows.agg(*[F.avg(F.col("vector")[i]) for i in range(dim)]).first()
    center = np.array([m or 0.0 for m in means])
    coded = materialize(rows.mapInArrow(_coder(dim, center), "vec_id long, raw binary, code binary, length double, product double"), "codes")
    asked = coded.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("raw").alias("raw"))
    qbs, vbs = max(1, -(-asked.count() // QUERY_BLOCK)), max(1, -(-n // VECTOR_BLOCK))
    all_of = lambda count: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))
    none = F.lit(None)
    left = asked.select(F.pmod(F.xxhash64("vec_id"), F.lit(qbs)).alias("qb"), all_of(vbs).alias("vb"), F.lit(0).alias("side"), "vec_id", "raw", none.cast("binary").alias("code"), none.cast("double").alias("length"), none.cast("double").alias("product"))
    right = coded.select(all_of(qbs).alias("qb"), F.pmod(F.xxhash64("vec_id", "raw"), F.lit(vbs)).alias("vb"), F.lit(1).alias("side"), "vec_id", "raw", "code", "length", "product")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 12)
    met = left.unionByName(right).repartition(parts, "qb", "vb").sortWithinPartitions("qb", "vb", "side")
    found = met.mapInArrow(_searcher(dim, center, k), "query_id long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
