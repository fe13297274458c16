"""Vector and text retrieval: exact cosine search by blocks, an inverted-file index, normalisation, rank fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The centroids are fitted on a sample of at most so many vectors; every vector is indexed.
FIT_ROWS = 20_000
#: Queries sent to the executors at a time, about; vectors in a part of a list, about.
QUERY_ROWS, PART_ROWS = 50_000, 50_000


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def unit(v: Column) -> Column:
    """The vector at length one; a zero vector stays."""
    n = F.sqrt(dot(v, v))
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(v.cast("array<double>"))


def fitted(v: Column, size: int) -> Column:
    """Cut or padded with zeros to a size."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), size)), 1, size)


def _unit_rows(col: pa.Array, n: int) -> np.ndarray:
    x = np.asarray(col.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(n, -1)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def top_rows(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, id, score) of the k best rows of ``x`` for each row of ``q``, ties at nine digits by id; in blocks of queries."""
    out = []
    for a in range(0, len(q), 1024):
        s = np.round(q[a : a + 1024] @ x.T, 9)
        if s.shape[1] > k:
            least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            r, c = np.nonzero(s >= least[:, None])
        else:
            r, c = (v.ravel() for v in np.indices(s.shape))
        v = s[r, c]
        order = np.lexsort((ids[c], -v, r))
        r, c, v = r[order], c[order], v[order]
        first = np.searchsorted(r, np.arange(len(s)))
        keep = np.arange(len(r)) - first[r] < k
        out.append((r[keep] + a, ids[c[keep]], v[keep]))
    return tuple(np.concatenate(p) for p in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


def _best(scored: DataFrame, k: int, key: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key))
    return scored.withColumn("rank", r).where(F.col("rank") <= k)


def search(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): exact top k of every query against all vectors.

    The queries, a stated set, are taken in blocks of about QUERY_ROWS by hash; of a block each partition of the vectors is
    read once, scored by matrix products, and only its own top k per query leaves it. Null vectors are left out."""
    queries = queries.where(F.col(column).isNotNull()).select(F.col(key).alias("q"), F.col(column).alias("v"))
    blocks = -(-queries.count() // QUERY_ROWS)
    out = vectors.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double")
    for i in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).orderBy("q").collect()
        if rows:
            out = out.unionByName(_search_block(vectors, np.array([r["q"] for r in rows]), np.array([r["v"] for r in rows], dtype=np.float64), k, key, column))
    return _best(out, k, key)


def _search_block(vectors: DataFrame, qids: np.ndarray, mat: np.ndarray, k: int, key: str, column: str) -> DataFrame:
    sent = vectors.sparkSession.sparkContext.broadcast((qids, mat / np.maximum(np.linalg.norm(mat, axis=1, keepdims=True), 1e-30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        for b in batches:
            if b.num_rows:
                at, got, score = top_rows(q, _unit_rows(b.column(1), b.num_rows), b.column(0).to_numpy(zero_copy_only=False).astype(np.int64), k)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(got), pa.array(score)], names=["query_id", key, "score"])

    return vectors.where(F.col(column).isNotNull()).select(F.col(key), F.col(column)).mapInArrow(run, f"query_id bigint, {key} bigint, score double")


def fit_centroids(vectors: DataFrame, lists: int, column: str = "embedding", seed: int = 5) -> np.ndarray:
    """Centroids by a few rounds of spherical k-means on at most FIT_ROWS vectors, taken by hash order of the vector."""
    rows = vectors.where(F.col(column).isNotNull()).select(column).orderBy(F.xxhash64(F.col(column).cast("string"))).limit(FIT_ROWS).collect()
    x = np.array([r[0] for r in rows], dtype=np.float64)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    c = x[np.random.default_rng(seed).permutation(len(x))[: min(lists, len(x))]]
    for _ in range(8):
        near = (x @ c.T).argmax(axis=1)
        for j in range(len(c)):
            m = x[near == j]
            if len(m):
                c[j] = m.mean(axis=0) / max(np.linalg.norm(m.mean(axis=0)), 1e-30)
    return c


def with_lists(vectors: DataFrame, centroids: np.ndarray, probes: int = 1, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, column, list): every vector with its nearest list, or its ``probes`` nearest lists."""
    sent = vectors.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(b.num_rows, -1)
            near = np.argsort(-(x @ c.T), axis=1)[:, :probes]
            idx = np.repeat(np.arange(b.num_rows), near.shape[1])
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(idx)), b.column(1).take(pa.array(idx)), pa.array(near.ravel().astype(np.int32))], names=[key, column, "list"])

    return vectors.where(F.col(column).isNotNull()).select(key, column).mapInArrow(run, f"{key} bigint, {column} array<float>, list int")


def ivf_search(vectors: DataFrame, queries: DataFrame, k: int, lists: int | None = None, probes: int | None = None, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, key, score, rank): top k within the probed lists. Without other numbers there are about the square root of
    the vectors in lists, three quarters of which are probed. A list is parted in salts of about PART_ROWS vectors on
    average, and in eight at least, as one may hold a third of all vectors; each part is scored by matrix products and only
    its top k leaves it."""
    n = vectors.count()
    lists = lists or max(1, int(n**0.5))
    probes = probes or -(-3 * lists // 4)
    salts = max(8, -(-n // (lists * PART_ROWS)))
    c = fit_centroids(vectors, lists, column)
    v = with_lists(vectors, c, 1, key, column).withColumn("salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    q = with_lists(queries, c, probes, key, column).select(F.col(key).alias("query_id"), F.col(column).alias("qv"), "list", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")).alias("salt"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", key, "score"]
        if not left.num_rows or not right.num_rows:
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x = _unit_rows(left.column(column).combine_chunks(), left.num_rows)
        at, got, score = top_rows(_unit_rows(right.column("qv").combine_chunks(), right.num_rows), x, left.column(key).to_numpy().astype(np.int64), k)
        return pa.Table.from_arrays([pa.array(right.column("query_id").to_numpy()[at]), pa.array(got), pa.array(score)], names=names)

    met = v.groupBy("list", "salt").cogroup(q.groupBy("list", "salt")).applyInArrow(run, f"query_id bigint, {key} bigint, score double")
    return _best(met, k, key).select("query_id", key, "score", "rank")
