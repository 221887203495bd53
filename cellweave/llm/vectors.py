"""What the vector searches share: valid vectors, packed shards, and query blocks against shards."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, let_go


def valid(v: Column) -> Column:
    """Not null, and every component a finite number."""
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & ok


def vector_rows(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """``vec_id, v, dim``: valid vectors, as doubles, with an id."""
    rows = df.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v"))


def dealt(rows: DataFrame, name: str, n: int) -> DataFrame:
    """``rows`` with a column ``name`` below ``n``, equal for equal ids."""
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as float64 rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim) if dim else np.zeros((len(column), 0))


def distinct_rows(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors), ascending by id, equal rows once; an id may have several vectors."""
    ids, x = t["vec_id"].to_numpy(), matrix(t["v"], t["dim"][0].as_py())
    order = np.lexsort((*x.T[::-1], ids))
    ids, x = ids[order], x[order]
    new = np.ones(len(ids), bool)
    new[1:] = (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)
    return ids[new], x[new]


#: A shard or a block of queries as one row.
PACKED = "dim int, part int, payload binary"


def packed(rows: DataFrame, name: str, n: int, work: Callable[[np.ndarray, np.ndarray], bytes]) -> DataFrame:
    """``rows`` dealt into ``n`` parts, each a row with what ``work`` makes of its ids and vectors."""

    def run(t: pa.Table) -> pa.Table:
        out = work(*distinct_rows(t))
        made = {"dim": pa.array([t["dim"][0].as_py()], pa.int32()), "part": pa.array([t[name][0].as_py()], pa.int32()), "payload": pa.array([out], pa.binary())}
        let_go()
        return pa.table(made)

    return dealt(rows, name, n).groupBy("dim", name).applyInArrow(run, PACKED)


def paired(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, work: Callable[[bytes, bytes, int], pa.Table], schema: str) -> DataFrame:
    """``work(shard, block, dim)`` for every block of queries and every shard, one pair at a time.

    Both are packed rows of a bounded size; a shard is copied once for each block of queries, of which
    there is one to some tens of thousands of queries."""
    left = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    right = blocks.withColumnRenamed("part", "block").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
    keys = ["dim", "part", "block"]
    none = pa.schema([("query_id", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64() if "score long" in schema else pa.float64())]).empty_table()

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return none
        out = work(a["payload"][0].as_py(), b["payload"][0].as_py(), a["dim"][0].as_py())
        let_go()
        return out

    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def result(query_ids: np.ndarray, x: np.ndarray, i: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    """Rows of ``query_id, row, vec_id, score``; ``row`` tells several vectors of a query's id apart."""
    row = np.zeros(len(query_ids), np.int64)
    again = np.flatnonzero(query_ids[1:] == query_ids[:-1]) + 1  # ascending by id, then by vector
    for j in again:
        row[j] = row[j - 1] + 1
    return pa.table({"query_id": query_ids[i], "row": row[i], "vec_id": ids, "score": scores})


def best(parts: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query row: ``query_id, rank`` from 1, ``vec_id, score``."""
    order = Window.partitionBy("query_id", "row").orderBy(F.desc("score"), "vec_id")
    out = parts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def blocks_of(n: int, size: int) -> int:
    return max(1, -(-n // size))
