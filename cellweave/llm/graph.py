"""Approximate nearest neighbours on robust-pruned directed graphs, one for each shard.

Equal vectors are one node.  A shard's graph starts random and is built in two passes over its
nodes: a greedy beam search for the node from the shard's medoid proposes the nodes it visited; of
these, nearest first, each is kept unless a kept one is nearer to it, by the factor ``alpha``, than
the node itself is (1 in the first pass, 1.2 in the second, which leaves long edges).  Kept edges
also run backwards, and a node with too many is pruned by the same rule.  A query's beam search runs
on every shard and the results are merged.  All searches of a batch advance together in numpy.

Distances on the graph are squared Euclidean between vectors of length 1, which order like the
cosine; reported scores are the cosine of the original vectors in double precision.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import embeddings, staged
from .exchange import pack, unpack
from .vectors import best, blocks_of, packed, paired, result, vector_rows

SHARD_ROWS, BLOCK_ROWS, DEGREE, SLACK, BATCH = 8_192, 32_768, 24, 16, 256
#: Nodes kept by a search while the graph is built, and by a query's.
BEAM, WIDE_BEAM = 40, 96


def _beam(x: np.ndarray, edges: np.ndarray, start: int, q: np.ndarray, beam: int, visited: bool = False):
    """Greedy searches for all rows of q at once: the nearest nodes found and their distances,
    nearest first; -1 and inf where there are fewer.  With ``visited``, of all nodes expanded."""
    n, rows, width = len(x), np.arange(len(q)), edges.shape[1]
    seen = np.zeros((len(q), n + 1), bool)
    seen[:, n] = True
    pool, dist = np.full((len(q), beam), n), np.full((len(q), beam), np.inf)
    done = np.ones((len(q), beam), bool)
    pool[:, 0], dist[:, 0], done[:, 0] = start, ((q - x[start]) ** 2).sum(1), False
    seen[:, start] = True
    trail, trail_d = [], []
    active = rows
    while len(active):
        d = np.where(done[active], np.inf, dist[active])
        at = d.argmin(1)
        live = np.isfinite(d[np.arange(len(active)), at])
        active, at = active[live], at[live]
        if not len(active):
            break
        node = pool[active, at]
        done[active, at] = True
        if visited:
            t, td = np.full(len(q), n), np.full(len(q), np.inf)
            t[active], td[active] = node, dist[active, at]
            trail.append(t)
            trail_d.append(td)
        nbr = edges[node]
        fresh = ~seen[active[:, None], nbr]
        seen[active[:, None], nbr] = True
        nd = np.where(fresh, 2 - 2 * np.matmul(x[np.minimum(nbr, n - 1)], q[active][:, :, None])[:, :, 0], np.inf)
        nd = np.where(fresh, np.maximum(nd, 0), np.inf)
        all_p, all_d = np.concatenate((pool[active], nbr), 1), np.concatenate((dist[active], nd), 1)
        all_f = np.concatenate((done[active], np.zeros((len(active), width), bool)), 1)
        keep = np.argpartition(all_d, beam - 1, 1)[:, :beam]
        pool[active], dist[active], done[active] = (np.take_along_axis(a, keep, 1) for a in (all_p, all_d, all_f))
    if visited:
        pool, dist = np.stack(trail, 1), np.stack(trail_d, 1)
    order = np.argsort(dist, 1, kind="stable")
    return np.take_along_axis(pool, order, 1), np.take_along_axis(dist, order, 1)


def _prune(x: np.ndarray, nodes: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of each node's candidates (n: none); rows of ``degree`` neighbours."""
    n = len(x)
    cand = np.where(cand == nodes[:, None], n, cand)
    cand = np.sort(cand, 1)
    cand[:, 1:][cand[:, 1:] == cand[:, :-1]] = n  # each once
    safe = np.minimum(cand, n - 1)
    d = np.where(cand < n, np.maximum(2 - 2 * np.matmul(x[safe], x[nodes][:, :, None])[:, :, 0], 0), np.inf)
    width = min(d.shape[1], 3 * degree)
    near = np.argsort(d, 1, kind="stable")[:, :width]
    cand, d = np.take_along_axis(cand, near, 1), np.take_along_axis(d, near, 1)
    vec = x[np.minimum(cand, n - 1)]
    between = np.maximum(2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1)), 0)
    out, rows = np.full((len(nodes), degree), n), np.arange(len(nodes))
    alive, got = np.isfinite(d), np.zeros(len(nodes), int)
    for j in range(width):  # nearest first; a row takes column j if it is still alive
        take = alive[:, j] & (got < degree)
        r = rows[take]
        out[r, got[r]] = cand[r, j]
        got[r] += 1
        alive[r] &= alpha * alpha * between[r, j] > d[r]
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, seed: int = 9) -> tuple[np.ndarray, int]:
    """The graph of distinct unit vectors: rows of neighbours (n: none), and the start node."""
    n, rng = len(x), np.random.default_rng(seed)
    start = int((x @ x.mean(0)).argmax())
    if n <= degree + 1:
        edges = np.full((n, degree), n)
        for i in range(n):
            edges[i, : n - 1] = np.delete(np.arange(n), i)
        return edges, start
    wide = degree + SLACK  # a node is pruned only when that many edges are full
    x = x.astype(np.float32)
    edges = np.full((n, wide), n)
    edges[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for alpha in (1.0, 1.2):
        for part in np.array_split(rng.permutation(n), blocks_of(n, BATCH)):
            found, _ = _beam(x, edges, start, x[part], beam, visited=True)
            kept = _prune(x, part, np.concatenate((found, edges[part]), 1), degree, alpha)
            edges[part, :degree], edges[part, degree:] = kept, n
            src, dst = np.repeat(part, degree), kept.ravel()
            src, dst = src[dst < n], dst[dst < n]
            order = np.argsort(dst, kind="stable")
            src, dst = src[order], dst[order]
            into, first, count = np.unique(dst, return_index=True, return_counts=True)
            back = np.full((len(into), count.max()), n)
            back[np.repeat(np.arange(len(into)), count), np.arange(len(dst)) - np.repeat(first, count)] = src
            both = np.sort(np.concatenate((edges[into], back), 1), 1)
            both[:, 1:][both[:, 1:] == both[:, :-1]] = n
            both = np.sort(both, 1)
            over = both[:, wide] < n if both.shape[1] > wide else np.zeros(len(into), bool)
            edges[into[~over]] = both[~over][:, :wide]
            for some in np.array_split(np.flatnonzero(over), blocks_of(int(over.sum()), BATCH)):
                if len(some):
                    edges[into[some], :degree], edges[into[some], degree:] = _prune(x, into[some], both[some], degree, alpha), n
    return edges, start


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows over a power of two near their greatest component: exact, and squares stay in range."""
    big = np.abs(x).max(1, keepdims=True) if x.shape[1] else np.ones((len(x), 1))
    return np.ldexp(x, -np.frexp(big)[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def build_shard(ids: np.ndarray, x: np.ndarray) -> dict:
    """A shard's index as arrays: nodes are distinct vectors, ``owner`` maps rows, ascending by id, to nodes."""
    nodes, owner = np.unique(x, axis=0, return_inverse=True)
    edges, start = build(_unit(nodes))
    return {"ids": ids, "owner": owner.reshape(-1), "nodes": nodes, "edges": edges, "start": start}


def search_shard(index: dict, q: np.ndarray, q_ids: np.ndarray, k: int, beam: int = WIDE_BEAM):
    """(query position, vec_id, cosine): up to k for each query."""
    ids, nodes = index["ids"], index["nodes"]
    by_node = np.argsort(index["owner"], kind="stable")  # ids ascend within a node
    first = np.searchsorted(index["owner"][by_node], np.arange(len(nodes) + 1))
    unit, unit_q = _unit(nodes), _unit(q)
    low = unit.astype(np.float32)
    out: tuple[list, list, list] = ([], [], [])
    for lo in range(0, len(q), BATCH):
        pool, dist = _beam(low, index["edges"], index["start"], unit_q[lo : lo + BATCH].astype(np.float32), beam)
        for i in range(len(pool)):
            own, got_ids, got_s = pool[i][np.isfinite(dist[i])][: 4 * k], [], []
            for node, s in zip(own, cosines(nodes[own], q[lo + i]), strict=True):
                mine = ids[by_node[first[node] : first[node + 1]]]
                # of a node's rows the least ids can count, beside the query's own
                members = mine[: k + 1 + int((mine[: k + 1] == q_ids[lo + i]).sum())]
                members = members[members != q_ids[lo + i]][:k]
                got_ids.append(members)
                got_s.append(np.full(len(members), s))
            got_ids, got_s = np.concatenate(got_ids), np.concatenate(got_s)
            keep = np.lexsort((got_ids, -got_s))[:k]
            out[0].append(np.full(len(keep), lo + i))
            out[1].append(got_ids[keep])
            out[2].append(got_s[keep])
    return tuple(np.concatenate(o) if o else np.zeros(0) for o in out)


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Cosines of rows with a vector, of any size of components."""
    x, q = _scaled(x), _scaled(q[None])[0]
    return (x @ q) / (np.sqrt((x * x).sum(1)) * np.sqrt(q @ q))


def index_shard(ids: np.ndarray, x: np.ndarray) -> bytes:
    """A shard's whole graph, packed; vectors keep the precision that they need."""
    g = build_shard(ids, x)
    return pack(g["ids"], g["owner"].astype(np.int32), _narrow(g["nodes"]).ravel(), g["edges"].astype(np.int32).ravel(), np.array([g["start"]]), ascending=1)


def open_shard(payload: bytes, dim: int) -> dict:
    ids, owner, nodes, edges, start = unpack(payload)
    nodes = nodes.reshape(-1, dim).astype(np.float64)
    return {"ids": ids, "owner": owner, "nodes": nodes, "edges": edges.reshape(len(nodes), -1).astype(np.int64), "start": int(start[0])}


def _narrow(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        low = x.astype(np.float32)
    return low if (low.astype(np.float64) == x).all() else x


def nearest(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
            shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows that ``queries`` (of ``vec_id``) marks.

    The score is the cosine of the vectors as doubles.  Candidates are all rows but those of the
    query's own id, of the same length.  Rows without an id, and vectors that are null, zero or hold
    null or non-finite components, take no part; equal rows count once, and different vectors of one
    id are a query, and a candidate, each.  No queries or no candidates: no rows.  Other columns are
    not read.
    """
    rows = vector_rows(vectors, id_col, vec_col).where(F.exists("v", lambda x: x != 0))
    n, m = rows.agg(F.count("*"), F.count_if(queries)).first()
    n_shards, n_blocks = blocks_of(n, shard_rows), blocks_of(m, block_rows)

    def block(ids: np.ndarray, x: np.ndarray) -> bytes:
        return pack(ids, _narrow(x).ravel(), ascending=1)

    def work(shard: bytes, block: bytes, dim: int) -> pa.Table:
        q_ids, q = unpack(block)
        q = q.reshape(len(q_ids), dim).astype(np.float64)
        i, ids, s = search_shard(open_shard(shard, dim), q, q_ids, k)
        return result(q_ids, q, i.astype(np.int64), ids.astype(np.int64), s.astype(float))

    index = staged(packed(rows, "shard", n_shards, index_shard), "graph")
    parts = paired(index, packed(rows.where(queries), "block", n_blocks, block), n_shards, n_blocks, work, "query_id long, row long, vec_id long, score double")
    return best(parts, k)


def op9_robust_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, rank, vec_id, score``: the 5 nearest found by cosine of every fiftieth vector among
    all others.  Invalid vectors, ties, repeats and empty tables as in ``nearest``."""
    return nearest(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0)
