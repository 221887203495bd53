"""Exact top-k inner products by vector-approximation files.

A shard's vectors are quantised, a cell of 8 bits for each component, as wide in all vectors.  A scan
of the cells alone, one product with the cells' middles, gives each vector a lower and an upper
bound of its score; whatever can't reach the k-th largest lower bound is out.  Exact vectors are then
read in the order of their bounds, and the reading stops when the k-th best exact score is above
every bound still unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import embeddings, staged
from .exchange import pack, unpack
from .vectors import best, blocks_of, packed, paired, result, vector_rows

SHARD_ROWS, BLOCK_ROWS, CELLS = 32_768, 32_768, 256
#: Scores of a batch of queries held at once.
AT_ONCE = 2 << 20


def narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the narrowest kind that holds them."""
    x = x.astype(np.int64)
    return x.astype(np.promote_types(np.min_scalar_type(int(x.min(initial=0))), np.min_scalar_type(int(x.max(initial=0)))) if x.size else np.int8)


class VAFile:
    """Integer vectors, ascending by id, with their cells."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, cells: np.ndarray | None = None):
        self.ids, self.x = ids, x.astype(np.int64)
        self.low = self.x.min(0) if len(x) else np.zeros(x.shape[1], np.int64)
        self.width = -(-((self.x.max(0) - self.low + 1) if len(x) else np.ones(x.shape[1], np.int64)) // CELLS)
        self.cells = ((self.x - self.low) // self.width).astype(np.uint8) if cells is None else cells

    def search(self, q: np.ndarray, q_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position of the query, position of the vector, score) of each query's k best."""
        out: tuple[list, list, list] = ([], [], [])
        reach = (self.width - 1) / 2  # from a cell's middle to its farthest vector
        middle = (self.low + self.cells.astype(np.int64) * self.width) + reach
        most = np.abs(middle).max(0) if len(middle) else np.zeros(q.shape[1])
        for start in range(0, len(q), max(1, AT_ONCE // max(1, len(self.ids)))):
            part = q[start : start + max(1, AT_ONCE // max(1, len(self.ids)))].astype(float)
            about = part @ middle.T
            slack = np.abs(part) @ (reach + most * (len(most) + 2) * 2.0**-50)  # of the cells, and of rounding
            for i, line in enumerate(about):
                own = slice(*np.searchsorted(self.ids, [q_ids[start + i], q_ids[start + i] + 1]))
                line[own] = -np.inf
                at, score = self._refine(q[start + i], line, slack[i], k)
                out[0].append(np.full(len(at), start + i))
                out[1].append(at)
                out[2].append(score)
        return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)

    def _refine(self, q: np.ndarray, about: np.ndarray, slack: float, k: int):
        """about -/+ slack are the bounds; -inf: no candidate."""
        kth = np.partition(about, -k)[-k] if len(about) >= k else -np.inf
        candidates = np.flatnonzero((about >= kth - 2 * slack) & (about > -np.inf))
        candidates = candidates[np.lexsort((candidates, -about[candidates]))]
        found, scores, at, step = np.zeros(0, np.int64), np.zeros(0, np.int64), 0, 4 * k
        while at < len(candidates):
            if len(found) == k and about[candidates[at]] + slack < scores[-1]:
                break  # certain: no unread bound reaches the k-th score; an equal one may win by its id
            read = candidates[at : at + step]
            found = np.concatenate((found, read))
            scores = np.concatenate((scores, self.x[read] @ q))
            keep = np.lexsort((found, -scores))[:k]
            found, scores, at, step = found[keep], scores[keep], at + step, 2 * step
        return found, scores


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id",
                       vec_col: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``queries`` (of ``vec_id``) marks.

    Components, as doubles, become ``floor(scale * x)``; the score is the integer inner product.
    Candidates are all rows but those of the query's own id, of the same length; ties go to the
    smaller id.  Rows without an id, and vectors that are null or hold null or non-finite
    components, take no part; equal rows count once, and different vectors of one id are a query,
    and a candidate, each.  Components so large that a score might not fit a long raise ValueError.
    No queries or no candidates: no rows.  Other columns are not read.
    """
    rows = vector_rows(vectors, id_col, vec_col).withColumn("v", F.transform("v", lambda x: x * scale))
    n, m, dim, top = rows.agg(F.count("*"), F.count_if(queries), F.max("dim"), F.max(F.array_max(F.transform("v", F.abs)))).first()
    if (top or 0.0) >= 2.0**52 or (dim or 0) * ((top or 0.0) + 1) ** 2 >= 2.0**62:
        raise ValueError("scores of so large components might not fit a long")
    rows = rows.withColumn("v", F.transform("v", lambda x: F.floor(x).cast("double")))
    n_shards, n_blocks = blocks_of(n, shard_rows), blocks_of(m, block_rows)

    def shard(ids: np.ndarray, x: np.ndarray) -> bytes:
        va = VAFile(ids, x)
        return pack(ids, va.cells.ravel(), narrow(va.x).ravel(), ascending=1)

    def block(ids: np.ndarray, x: np.ndarray) -> bytes:
        return pack(ids, narrow(x).ravel(), ascending=1)

    def work(shard: bytes, block: bytes, dim: int) -> pa.Table:
        ids, cells, x = unpack(shard)
        q_ids, q = unpack(block)
        q = q.reshape(len(q_ids), dim).astype(np.int64)
        i, j, s = VAFile(ids, x.reshape(len(ids), dim), cells.reshape(len(ids), dim)).search(q, q_ids, k)
        return result(q_ids, q, i, ids[j], s)

    index = staged(packed(rows, "shard", n_shards, shard), "cells")
    parts = paired(index, packed(rows.where(queries), "block", n_blocks, block), n_shards, n_blocks, work, "query_id long, row long, vec_id long, score long")
    return best(parts, k)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: the 5 highest integer inner products of every fiftieth vector
    with all others.  Invalid vectors, ties, repeats and empty tables as in ``top_inner_products``."""
    return top_inner_products(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (
  SELECT DISTINCT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR isnan(x) OR isinf(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, q.v, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM s
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
