"""Nearest neighbours by randomly rotated one-bit codes, with exact reranking.

A vector is its distance from a centre times a direction.  The direction is rotated at random
and kept as one bit per dimension, with two scalars that correct the estimate: an inner product
with a query is estimated from the bits alone, with a known spread of its error.  Candidates whose
estimate plus bound reaches the worst of the best so far are reranked on the original vectors in
double precision.

Equal vectors are one point with its smallest ids, so copies of any number cost one point.  The
query points meet all points in blocks of bounded size; only each block's best leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loadgauge.llm.common import one_row_per_id
from loadgauge.plans.joining import settle

SEED = 11
SAMPLE = 4096  # points that fix the centre
EPSILON = 1.9  # standard spreads of the estimate that the bound allows for
BLOCK = 8192
FIRST = 64  # best estimates of a query reranked first, to fix its threshold
SALTS = 1024
_CELLS = 1 << 22


@dataclass(frozen=True)
class Coder:
    centre: np.ndarray
    rotation: np.ndarray

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(packed bits, distance from the centre over agreement, error spread) of each vector."""
        rest = vectors.astype(np.float64) - self.centre
        length = np.linalg.norm(rest, axis=1)
        turned = (rest / np.where(length > 0, length, 1.0)[:, None]) @ self.rotation
        bits = turned > 0
        # How well the bits stand for the direction: the inner product of the two.
        agreement = np.abs(turned).sum(axis=1) / math.sqrt(turned.shape[1])
        agreement = np.where(length > 0, agreement, 1.0)
        spread = np.sqrt(np.maximum(1 - agreement**2, 0)) / agreement / math.sqrt(max(turned.shape[1] - 1, 1))
        return np.packbits(bits, axis=1), length / agreement, length * spread

    def estimates(self, queries: np.ndarray, bits: np.ndarray, scale: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimated inner product, spread of its error) of every query and code."""
        dim = queries.shape[1]
        signs = np.unpackbits(bits, axis=1, count=dim).astype(np.float32) * 2 - 1
        turned = (queries @ self.rotation).astype(np.float32)
        inner = turned @ signs.T / np.float32(math.sqrt(dim))
        return (queries @ self.centre)[:, None] + inner * scale, np.linalg.norm(queries, axis=1)[:, None] * spread


def fit(points: DataFrame, dim: int, sample: int = SAMPLE, seed: int = SEED) -> Coder:
    """A random rotation, and the mean of at most ``sample`` points as centre."""
    rows = points.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(sample).collect()
    mean = np.mean([np.frombuffer(r.vec, "<f4") for r in rows], axis=0, dtype=np.float64) if rows else np.zeros(dim)
    gauss = np.random.default_rng(seed).standard_normal((dim, dim))
    return Coder(mean, np.linalg.qr(gauss)[0])


def best_of_block(
    coder: Coder, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, epsilon: float = EPSILON
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, vector row, exact inner product) of the k best of each query, ties to smaller ids."""
    bits, scale, spread = coder.encode(vectors)
    exact_v = vectors.astype(np.float64)
    parts = []
    step = max(1, _CELLS // max(1, len(vectors)))
    for begin in range(0, len(queries), step):
        exact_q = queries[begin : begin + step].astype(np.float64)
        guess, error = coder.estimates(exact_q, bits, scale, spread)
        n = len(vectors)
        if n > max(FIRST, k):
            first = np.argpartition(-guess, max(FIRST, k) - 1, axis=1)[:, : max(FIRST, k)]
            score = np.einsum("qd,qfd->qf", exact_q, exact_v[first])
            least = -np.partition(-score, k - 1, axis=1)[:, k - 1]
            q, v = np.nonzero(guess + epsilon * error >= least[:, None])
            seen = np.zeros(guess.shape, bool)
            np.put_along_axis(seen, first, True, axis=1)
            seen[q, v] = True
            q, v = np.nonzero(seen)
        else:
            q, v = np.divmod(np.arange(len(exact_q) * n), max(n, 1))
        score = np.empty(len(q))
        for i in range(0, len(q), 1 << 17):
            part = slice(i, i + (1 << 17))
            score[part] = np.einsum("id,id->i", exact_q[q[part]], exact_v[v[part]])
        order = np.lexsort((ids[v], -score, q))
        q, v, score = q[order], v[order], score[order]
        begins = np.searchsorted(q, np.arange(len(exact_q)))
        top = np.arange(len(q)) - begins[q] < k
        parts.append((q[top] + begin, v[top], score[top]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, int), np.empty(0, int), np.empty(0))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f4").reshape(-1, dim)


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(vec_id, vec as float32 bytes) of the vectors that take part, and their dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = []
            for value in batch.column(1):
                raw = value.as_py()
                ok = raw and all(x is not None and math.isfinite(x) for x in raw) and any(raw)
                vecs.append((np.array(raw, "<f4") + np.float32(0)).tobytes() if ok else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vecs, pa.binary())], ["vec_id", "vec"])

    named = rows.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(vec_col).cast("array<float>"))
    found = settle(named.mapInArrow(run, "vec_id long, vec binary").filter("vec is not null"))
    sizes = found.groupBy(F.octet_length("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    dim = sizes[0].n // 4 if sizes else 0
    return one_row_per_id(found.filter(F.octet_length("vec") == 4 * dim), "vec_id", "vec"), dim


def nearest(
    rows: DataFrame, is_query: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
    epsilon: float = EPSILON,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest of all other vectors.

    ``is_query`` is a SQL condition on vec_id.  Nearness is the inner product on the original
    vectors, ties go to the smaller vec_id.  Vectors that are null, empty, zero or hold null or
    non-finite components take no part, nor do those of another length than most, nor rows
    without id; of rows that repeat an id the least vector counts.  A query with fewer than k
    others gets them all; an empty table gives no rows.
    """
    vectors, dim = valid_vectors(rows, id_col, vec_col)
    more = k + 1  # a query's own row may be among its nearest
    smallest = F.slice(F.sort_array(F.collect_list("vec_id")), 1, more)
    salted = vectors.groupBy("vec", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)).alias("salt")).agg(smallest.alias("ids"))
    points = salted.groupBy("vec").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, more).alias("ids"))
    points = settle(points.select(F.col("ids")[0].alias("uid"), "vec", "ids"))
    asked = settle(
        vectors.filter(is_query).withColumnRenamed("vec_id", "query_id").join(points.select("uid", "vec"), "vec").select("query_id", "uid")
    )
    query_points = settle(asked.select("uid").distinct().join(points, "uid").select("uid", "vec"))
    coder = fit(points, dim)
    n_blocks = max(1, math.ceil(points.count() / BLOCK))
    q_blocks = max(1, math.ceil(query_points.count() / BLOCK))
    spread = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    blocks = points.select("uid", "vec", spread(n_blocks).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("q"))
    queries = query_points.select("uid", "vec", spread(q_blocks).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("b"))

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("uid").to_numpy()
        asks = right.column("uid").to_numpy()
        q, v, score = best_of_block(coder, _matrix(right.column("vec"), dim), _matrix(left.column("vec"), dim), ids, more, epsilon)
        return pa.table({"quid": pa.array(asks[q], pa.int64()), "uid": pa.array(ids[v], pa.int64()), "score": pa.array(score, pa.float64())})

    found = blocks.groupBy("b", "q").cogroup(queries.groupBy("b", "q")).applyInArrow(search, "quid long, uid long, score double")
    best = Window.partitionBy("quid").orderBy(F.desc("score"), "uid")
    top = found.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= more)
    near = F.transform("ids", lambda i: F.struct((-F.col("score")).alias("s"), i.alias("vec_id")))
    lists = top.join(points.select("uid", "ids"), "uid").groupBy("quid").agg(
        F.slice(F.sort_array(F.flatten(F.collect_list(near))), 1, more).alias("near")
    )
    answers = asked.join(lists.withColumnRenamed("quid", "uid"), "uid")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    ranked = answers.select("query_id", F.posexplode(others).alias("rank", "hit"))
    return ranked.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.s")).alias("score"))
