"""SimHash near-duplicates by multi-index hashing.

A text's fingerprint takes the majority of each bit over the hashes of its word shingles.
Fingerprints link at ``radius`` or fewer differing bits.  They are cut into segments; by the
pigeonhole principle two linked fingerprints differ, in some segment, by no more than that
segment's share of the radius.  Each fingerprint is stored in every segment's table under its
segment value, and looks up the small Hamming ball round that value (of two values, the lesser looks
up the greater, so a pair meets once).  Those that meet are compared over all bits.

Copies share a fingerprint and are one entry.  In a crowded bucket fingerprints are not compared
pair by pair: a pivot's neighbours within half the radius are near each other through it, and only
what lies just outside its reach is compared with them; a partition hands on a spanning forest of
its links, never all pairs.  Nothing is capped.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NO_ID, bitmap, col, documents, fresh, row_key, sift, staged
from .components import components, forest

#: (bits, radius) of each segment: while distances up to 4 are asked for, one segment must be within.
#: SMALL_PLAN is used at every size.  LARGE_PLAN gives the same links from longer segments and larger
#: balls: 282 rows for a fingerprint instead of 25, in buckets emptier by a factor of 1,024; it can be
#: asked for where the square of the bucket's size is what counts (tens of billions of fingerprints).
SMALL_PLAN = ((22, 1), (22, 1), (20, 0))
LARGE_PLAN = ((32, 2), (32, 1))


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z lower-cased, as UTF-8; bytes split and lower by exactly these rules."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str, shingle: int = 4) -> int:
    words = words_of(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words)))
    n = max(1, len(words) - shingle + 1)
    size, ones = min(shingle, len(words)), np.zeros(64, np.int64)
    h = xxhash.xxh64_intdigest
    for lo in range(0, n, 1 << 16):
        hi = min(n, lo + (1 << 16))
        starts = [(ends[i - 1] + i if i else 0) for i in range(lo, hi)]
        stops = [ends[i + size - 1] + i + size - 1 for i in range(lo, hi)]
        hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, stops)], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits((2 * ones > n).astype(np.uint8), bitorder="little")
    return int(bits.view("<u8")[0])


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of hashed shingles: a bit is 1 if set in over half of them."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """``key, fp`` of every row; fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x.as_py() or "", shingle) for x in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], names=["key", "fp"])

    rows = docs.select(row_key(col(id_col), col(text_col)).alias("key"), col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "key long, fp long")


def _probes(fp: np.ndarray, plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment and value, fingerprint, is it stored or looking up) for every table entry and lookup."""
    buckets, fps, home = [], [], []
    shift = 0
    for s, (bits, radius) in enumerate(plan):
        seg = (fp >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        shift += bits
        for r in range(radius + 1):
            for at in itertools.combinations(range(bits), r):
                value = seg ^ np.uint64(sum(1 << b for b in at))
                go = value > seg if r else np.ones(len(fp), bool)
                buckets.append((value[go] << np.uint64(2)) | np.uint64(s))
                fps.append(fp[go])
                home.append(np.full(int(go.sum()), r == 0))
    return np.concatenate(buckets), np.concatenate(fps), np.concatenate(home)


def crowded_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect whatever pairs within ``radius`` connect, in memory linear in ``fps``."""
    alive, us, vs, half = np.unique(fps), [], [], radius // 2
    while len(alive) > 1:
        pivot = alive[0]
        d = np.bitwise_count(alive ^ pivot)
        near = alive[(d <= radius) & (d > 0)]
        us.append(np.full(len(near), pivot))
        vs.append(near)
        ball = alive[d <= half]
        shell = alive[(d > radius) & (d <= radius + half)]  # may reach the ball but not its pivot
        for member in ball[1:] if len(ball) <= len(shell) else []:
            hit = np.bitwise_count(shell ^ member) <= radius
            us.append(np.full(int(hit.sum()), member))
            vs.append(shell[hit])
            shell = shell[~hit]  # one link to the ball is enough
        if len(ball) > len(shell):
            for x in shell:
                hit = np.flatnonzero(np.bitwise_count(ball ^ x) <= radius)[:1]
                us.append(np.full(len(hit), x))
                vs.append(ball[hit])
        alive = alive[d > half]
    return (np.concatenate(us), np.concatenate(vs)) if us else (alive[:0], alive[:0])


def bucket_links(bucket: np.ndarray, fp: np.ndarray, home: np.ndarray, radius: int, crowd: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as (fingerprint, root), of the verified links within buckets."""
    order = np.lexsort((~home, bucket))
    bucket, fp, home = bucket[order], fp[order], home[order]
    first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, int)
    size = np.diff(np.append(first, len(bucket)))
    homes = np.add.reduceat(home.astype(np.int64), first) if len(first) else size
    use = (homes > 0) & (size > 1)
    first, size, homes = first[use], size[use], homes[use]
    us, vs = [], []
    for f, n in zip(first[size > crowd], size[size > crowd]):
        u, v = crowded_links(fp[f : f + n], radius)
        us.append(u)
        vs.append(v)
    first, size, homes = first[size <= crowd], size[size <= crowd], homes[size <= crowd]
    # each stored entry, which come first, meets all that follow it in its bucket
    meets = homes * size - homes * (homes + 1) // 2
    cut = np.flatnonzero(np.diff(np.cumsum(meets) // (1 << 21), prepend=0))
    for part in np.split(np.arange(len(first)), cut):
        if not len(part):
            continue
        h = homes[part]
        entry = np.repeat(first[part], h) + (np.arange(h.sum()) - np.repeat(np.cumsum(h) - h, h))
        follow = np.repeat(first[part] + size[part], h) - entry - 1
        a = np.repeat(entry, follow)
        b = a + 1 + (np.arange(follow.sum()) - np.repeat(np.cumsum(follow) - follow, follow))
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        us.append(fp[a[ok]])
        vs.append(fp[b[ok]])
    if not us:
        return fp[:0], fp[:0]
    nodes, roots = forest(np.concatenate(us), np.concatenate(vs))
    return nodes[nodes != roots], roots[nodes != roots]


def links(fps: DataFrame, n: int, radius: int = 4, plan=SMALL_PLAN) -> DataFrame:
    """``n`` distinct ``fp`` -> ``u, v`` that connect whatever fingerprints within ``radius`` connect."""
    if sum(b for b, _ in plan) != 64 or sum(r + 1 for _, r in plan) <= radius:
        raise ValueError("the plan's segments don't cover the fingerprint and radius")
    per_row = sum(1 + sum(_choose(b, r) for r in range(1, rad + 1)) / 2 for b, rad in plan)
    spark = fps.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n * per_row) // 2_000_000 + 1)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            for lo in range(0, len(fp), 1 << 14):
                b, f, h = _probes(fp[lo : lo + (1 << 14)], plan)
                yield pa.RecordBatch.from_arrays([pa.array(b.view(np.int64)), pa.array(f.view(np.int64)), pa.array(h)], names=["bucket", "fp", "home"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).view(np.uint64), b.column(2).to_numpy(zero_copy_only=False)) for b in batches]
        if got:
            u, v = bucket_links(*(np.concatenate(x) for x in zip(*got)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    table = fps.select("fp").mapInArrow(probe, "bucket long, fp long, home boolean")
    return table.repartition(parts, "bucket").mapInArrow(meet, "u long, v long")


def _choose(n: int, k: int) -> int:
    return len(list(itertools.combinations(range(n), k)))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, shingle: int = 4) -> DataFrame:
    """A row per input row: ``doc_id, key, fp, component``; ``component`` is the least key reached.

    Null and empty texts have fingerprint 0 and link like others.  A row without an id has a key
    from its text, above all ids, so it heads a component only of its like.  Repeated rows each
    keep their row.  An empty table gives no rows; other columns are not read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    entries = staged(rows.groupBy("fp").agg(F.min("key").alias("head")), "fps")
    roots = components(links(entries, entries.count(), radius))
    named = roots.join(entries, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("head").alias("least"))
    of = roots.join(named.withColumnRenamed("root", "r"), F.col("root") == F.col("r")).select("node", "least")
    heads = staged(entries.join(of, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("least", "head").alias("component")), "heads")
    out = rows.join(heads, F.col("fp") == F.col("f"))
    return out.select(F.when(F.col("key") < NO_ID, F.col("key")).alias("doc_id"), "key", "fp", "component")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, classes: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` whose key heads a component, one for each key; columns as they were.

    classes: ``key, component`` of every row, by default those of ``near_duplicate_classes``.

    Only documents that go or are repeated, and the few that share their bit of a fixed-size
    bitmap, are shuffled."""
    if classes is None:
        classes = near_duplicate_classes(docs, id_col, text_col, radius)
    by_key = classes.groupBy("key").agg(F.count("*").alias("rows"), F.max((F.col("key") == F.col("component")).cast("int")).alias("head"))
    marked = staged(by_key.where("rows > 1 or head = 0"), "marked")
    key, mark = fresh(docs, "head_key", "head_mark")
    keyed = docs.withColumn(key, row_key(col(id_col), col(text_col))).withColumn(mark, F.xxhash64(col(key)))
    screen = bitmap(marked.select(F.xxhash64("key").alias("h")), "h")
    names = [col(c) for c in docs.columns]
    free = sift(keyed, mark, screen, False).select(*names)
    # merged at every size: the plan doesn't turn with the number of duplicates
    held = sift(keyed, mark, screen, True).join(marked.select(F.col("key").alias("marked_key"), "rows", "head").hint("merge"), col(key) == F.col("marked_key"), "left")
    single = held.where(F.col("marked_key").isNull()).select(*names)
    repeated = held.where("rows > 1 and head = 1")
    out = free.union(single)
    return out if marked.where("rows > 1 and head = 1").isEmpty() else out.union(repeated.dropDuplicates([key]).select(*names))


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every document: 4-word shingles, links at 4 bits or fewer.
    Nulls, empty texts, repeated rows and empty tables as in ``near_duplicate_classes``."""
    out = near_duplicate_classes(documents(spark, sf_dir))
    component = F.when(F.col("component") < NO_ID, F.col("component"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component.alias("component_id"))
