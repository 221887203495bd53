"""Near-duplicates by the exact similarity of word shingles.

Texts are sets of hashed shingles of ``SHINGLE`` words.  Those whose SimHash fingerprints multi-index
hashing connects at ``RADIUS`` or fewer bits meet.  Fewer bits than any index could look up round a
fingerprint tell the nearest pairs alone: at similarity ``LEAST`` ten of 64 differ on average.  So sets
also meet under their least elements in ``MINIMA`` random orders.  Two sets with a Jaccard similarity
of s have one in common with probability s, so a pair at ``LEAST`` stays apart there with probability
0.2 ** 8, under 3 in a million, and nearer pairs less.  Buckets with the same members are one.  Those
that meet are compared by their whole sets, and only pairs of similarity ``LEAST`` or more link.

Equal sets are one entry.  A bucket of many sets is split by size: each band of sizes meets the next.
In a bucket sets are not compared pair by pair.  A passage that many texts hold makes large buckets
of texts that are otherwise unlike; there sets meet anew under the elements that the fewest of them
share, which is exact (prefix and position filters).  Sets that are connected already need no
comparison, and Jaccard distance is a metric, so those within half the reach of a pivot are near each
other through it, and only what lies just outside the pivot's reach is compared with them.  A bucket
gives the links of a tree.  Nothing is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import bitmap, col, in_bitmap, lean, row_key, staged
from .components import components
from .exchange import mix
from .suffixarray import word_hashes

SHINGLE, MINIMA, RADIUS = 5, 8, 4
#: Similarities in tenths: of links, of sets that are near each other through a pivot, of those that may reach them.
LEAST, HALF, BEYOND = 8, 9, 7
#: A bucket of more sets is split by their sizes; one of no more than FEW is compared without looking for shared elements.
CROWD, FEW = 1024, 8
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str) -> np.ndarray:
    """Ascending distinct hashes of the shingles; a text of fewer words is one shingle."""
    words = word_hashes(text)
    size = min(SHINGLE, len(words))
    h = np.zeros(len(words) - size + 1 if size else 0, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(size):
            h = h * _STEP + words[j : j + len(h)]
    return np.unique(mix(h, size))


def set_id(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes()) if len(shingles) else 0


def minima(shingles: np.ndarray, orders: int = MINIMA) -> np.ndarray:
    """The bucket of the least element in each order."""
    if not len(shingles):
        return np.zeros(0, np.uint64)
    return np.array([mix(mix(shingles, 11 + i).min(keepdims=True), 31 + i)[0] for i in range(orders)], np.uint64)


def size_edges(most: int = 1 << 40) -> np.ndarray:
    """Least sizes of bands; sets of similarity LEAST are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] < most:
        out.append(-(-out[-1] * 10 // LEAST))
    return np.array(out)


def _overlap(one: np.ndarray, words: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(shared elements, elements of the union) of a set with each of others, which lie one after another."""
    at = np.minimum(np.searchsorted(one, words), len(one) - 1)
    shared = np.add.reduceat((one[at] == words).astype(np.int64), starts)
    return shared, len(one) + sizes - shared


def bucket_links(ids: np.ndarray, sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect whatever sets of similarity LEAST connect: a tree, so fewer than the sets."""
    n = len(ids)
    sizes, label, out = np.array([len(s) for s in sets], np.int64), np.arange(n), []

    def alike(i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = sizes[others]
        return _overlap(sets[i], np.concatenate([sets[j] for j in others]), np.cumsum(m) - m, m)

    def link(i: int, others: np.ndarray) -> None:
        labels, first = np.unique(label[others], return_index=True)
        out.extend((ids[i], ids[j]) for j in others[first[labels != label[i]]])
        label[np.isin(label, labels)] = label[i]

    def meet(members: np.ndarray, left: np.ndarray) -> None:
        """Connects the members' pairs of which neither shares more than its ``left`` elements."""
        order = np.argsort(sizes[members], kind="stable")
        members, s = members[order], sizes[members[order]]
        most = ((10 + LEAST) * left[order] - LEAST * s) // LEAST  # the largest set with which so many shared are enough
        here = np.ones(len(members), bool)
        for k in np.flatnonzero(most >= s).tolist():
            pivot = members[k]
            if not here[k]:
                continue
            larger = np.arange(k + 1, np.searchsorted(s, most[k], "right"))
            larger = larger[here[larger] & (most[larger] >= s[k])]
            apart = label[members[larger]] != label[pivot]
            if not apart.any():
                continue
            if 2 * apart.sum() < len(larger):  # mostly its own kind, with which no link is wanted
                larger = larger[apart]
            shared, union = alike(pivot, members[larger])
            near, ball = 10 * shared >= LEAST * union, larger[10 * shared >= HALF * union]
            if near.any():
                link(pivot, members[larger[near]])
            if len(ball):
                shell = np.arange(k + 1, np.searchsorted(s, min(most[ball].max(), 10 * s[k] // BEYOND), "right"))
                shell = shell[here[shell] & (most[shell] >= s[ball].min()) & (label[members[shell]] != label[pivot])]
                if len(shell):
                    shared, union = alike(pivot, members[shell])
                    shell = shell[10 * shared >= BEYOND * union]
                few, many = (members[ball], members[shell]) if len(ball) <= len(shell) else (members[shell], members[ball])
                for j in few:
                    others = many[label[many] != label[j]]
                    if len(others):
                        shared, union = alike(j, others)
                        link(j, others[10 * shared >= LEAST * union])
                here[ball] = False
            if near.any() and (label[members[k:]] == label[pivot]).all():
                break

    if n <= FEW:
        meet(np.arange(n), sizes)
        return out
    for members, left in rarest_shared(sets, sizes):
        if (label[members] != label[members[0]]).any():
            meet(members, left)
    return out


def rarest_shared(sets: list[np.ndarray], sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sets that have an element, elements of each from it on) so that each pair of similarity LEAST
    is together at the first element that it shares, from the element in the fewest sets up.

    A set of which less than LEAST occurs in others has no such pair, and of the others only the
    first elements count, before what is left is less than LEAST: a passage that many texts have
    comes last and brings together only texts that hold little else."""
    who = np.arange(len(sets))
    while len(who):
        m = sizes[who]
        words, inverse, count = np.unique(np.concatenate([sets[i] for i in who]), return_inverse=True, return_counts=True)
        ok = 10 * np.add.reduceat((count[inverse] > 1).astype(np.int64), np.cumsum(m) - m) >= LEAST * m
        if ok.all():
            break
        who = who[ok]
    if not len(who):
        return
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(words))
    owner, rank, often = np.repeat(np.arange(len(who)), m), rank[inverse], count[inverse] > 1
    order = np.lexsort((rank, owner))
    left = np.repeat(np.cumsum(m), m) - np.arange(len(owner))
    first = (10 * left >= LEAST * m[owner]) & often[order]
    order, owner, left = order[first], owner[first], left[first]
    at = np.argsort(rank[order], kind="stable")
    rank, owner, left = rank[order][at], owner[at], left[at]
    edges = np.flatnonzero(np.diff(rank, prepend=-1))
    known = mix(owner.astype(np.uint64), 7)
    same = set()
    for lo, hi, tag in zip(edges.tolist(), np.append(edges[1:], len(rank)).tolist(), np.bitwise_xor.reduceat(known, edges).tolist() if len(edges) else []):
        if hi - lo > 1 and (hi - lo, tag) not in same:  # pairs of the same sets share the earlier element
            same.add((hi - lo, tag))
            yield who[owner[lo:hi]], left[lo:hi]


def similar_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", orders: int = MINIMA, radius: int = RADIUS) -> DataFrame:
    """A row per input row: ``key, fp, component``; ``fp`` names the row's set of shingles and
    ``component`` is the least key reached.  Null and empty texts are alike.

    With no ``orders`` only sets that the fingerprints' index connects within ``radius`` bits meet."""
    rows = docs.select(row_key(col(id_col), col(text_col)).alias("key"), col(text_col).cast("string").alias("text"))

    edges = size_edges()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py() or "") for x in b.column(1)]
            least = [minima(s, orders).view(np.int64) for s in sets]
            prints = np.array([simhash.majority(s) for s in sets], np.uint64).view(np.int64)
            ids = np.array([set_id(s) for s in sets], np.uint64).view(np.int64)
            band = np.searchsorted(edges, [len(s) for s in sets], "right")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids), pa.array(band, pa.int32()), pa.array(prints), pa.array(least, pa.list_(pa.int64()))], names=["key", "fp", "band", "print", "minima"])

    known = staged(rows.mapInArrow(lean(describe), "key long, fp long, band int, print long, minima array<long>"), "sets")
    entries = staged(known.groupBy("fp").agg(F.min("key").alias("head"), F.min("band").alias("band"), F.min("print").alias("print"), F.min("minima").alias("minima")), "entries")
    prints = staged(entries.where("band > 0").select(F.col("print").alias("fp")).distinct(), "prints")
    near = components(simhash.links(prints, prints.count(), radius)).select("node", "root")
    # merged at every size: the plan doesn't turn with the number of links
    classed = entries.where("band > 0").join(near.hint("merge"), F.col("print") == F.col("node"), "left")
    index = F.xxhash64(F.lit("print"), F.coalesce("root", "print"))
    under = classed.select("fp", "head", "band", F.explode(F.concat("minima", F.array(index))).alias("bucket"))
    members = under.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).where("n > 1")
    kept = members.groupBy("n", "who").agg(F.min("bucket").alias("kept"))
    banded = F.array(F.xxhash64("bucket", "band"), F.xxhash64("bucket", F.col("band") + 1))
    places = F.when(F.col("n") > CROWD, banded).otherwise(F.array("bucket"))
    meets = under.join(kept.hint("merge"), F.col("bucket") == F.col("kept")).groupBy("fp", "head").agg(F.flatten(F.collect_list(places)).alias("buckets"))
    meets = staged(meets, "meets")
    screen = docs.sparkSession.sparkContext.broadcast(bitmap(meets, "fp"))
    n = meets.agg(F.sum(F.size("buckets"))).first()[0] or 0

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py() or "") for x in b.column(1)]
            ids = np.array([set_id(s) for s in sets], np.uint64)
            ok = np.flatnonzero(in_bitmap(screen.value, ids)) if len(ids) else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ok, pa.int64())), pa.array(ids[ok].view(np.int64)), pa.array([sets[i].tobytes() for i in ok], pa.binary())], names=["key", "of", "shingles"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)), np.asarray(b.column(1)), b.column(2)) for b in batches if b.num_rows]
        if not got:
            return
        bucket, ids = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        blobs = pa.chunked_array([x[2] for x in got]).combine_chunks()
        order = np.lexsort((ids, bucket))
        order = order[np.concatenate(([True], (np.diff(bucket[order]) != 0) | (np.diff(ids[order]) != 0)))]  # rows given twice
        us, vs = [], []
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            for u, v in bucket_links(ids[group], [np.frombuffer(blobs[i].as_py(), np.uint64) for i in group.tolist()]) if len(group) > 1 else ():
                us.append(u)
                vs.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(n) // 8_000 + 1)
    sets = rows.mapInArrow(lean(shingled), "key long, of long, shingles binary").join(meets.hint("merge"), (F.col("of") == F.col("fp")) & (F.col("key") == F.col("head")))
    links = sets.select(F.explode("buckets").alias("bucket"), "fp", "shingles").repartition(parts, "bucket").mapInArrow(lean(meet), "u long, v long")
    roots = components(links)
    named = roots.join(entries, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("head").alias("least"))
    of = roots.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "least")
    heads = staged(entries.join(of, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("least", "head").alias("component")), "heads")
    return known.join(heads, F.col("fp") == F.col("f")).select("key", "fp", "component")
