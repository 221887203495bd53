"""Repeated passages by sparse suffix arrays.

Suffixes are retained only at minimisers: a position whose hash of ``GRAM`` words is the least of
some ``WINDOW`` neighbouring ones.  Equal passages select equal positions, and a passage of
``PASSAGE`` words has one within its first ``WINDOW`` words, so that at least ``CORE`` words of the
passage follow it.

Suffixes whose first ``CORE`` words occur once in the corpus are gone after a count.  The others
carry the words round them; a match of ``PASSAGE`` words has some of its other words before the
position and the rest after the core, and suffixes are sorted by each such split of the words, so
that all that share them meet, however many they are.  Matches of ``PASSAGE`` words or more between
different documents are reported, merged over the suffixes of a document.

Suffixes with equal words all round collapse to one before they are sorted.  A core that is very
frequent is not sorted as one group: a match of PASSAGE words has ``SIDE`` more equal words after or
before the core, so such suffixes are grouped by the longer runs, once for each side.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NO_ID, bitmap, col, documents, in_bitmap, row_key, staged
from .exchange import PACKED, batch, mix, pair, ranges_for, reduced, split_sorted, summed

PASSAGE, GRAM, WINDOW = 50, 8, 20
CORE = PASSAGE - WINDOW + 1
#: Words carried before a suffix and after its core.
LEFT, RIGHT = 20, 22
SIDE = (PASSAGE - CORE + 1) // 2
#: Cores of so many suffixes count as frequent, tokens at once.
FREQUENT, BLOCK = 2_000, 400_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_POWERS: list[np.ndarray] = []


def word_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _slide(a: np.ndarray, n: int, best) -> np.ndarray:
    """best over a[i : i + n] for each i with all n there."""
    out, have = a, 1
    while have < n:
        step = min(have, n - have)
        out = best(out[: len(out) - step], out[step:])
        have += step
    return out


def minimisers(words: np.ndarray) -> np.ndarray:
    """Positions selected in a run of words that has at least GRAM of them."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(words) - GRAM + 1, np.uint64)
        for j in range(GRAM):
            h = h * _STEP + words[j : j + len(h)]
    h = mix(h)
    n = min(WINDOW, len(h))
    least = _slide(h, n, np.minimum)
    wide = np.concatenate((np.zeros(n - 1, np.uint64), least, np.zeros(n - 1, np.uint64)))
    return np.flatnonzero(_slide(wide, n, np.maximum)[: len(h)] == h)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(n - 1, x)))) for x in (_STEP, inverse)]
    return _POWERS[0], _POWERS[1]


def runs(words: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n words from each position."""
    up, down = _powers(max(len(words) + 1, 1 << 16))
    with np.errstate(over="ignore"):
        upto = np.concatenate(([np.uint64(0)], np.cumsum(mix(words) * up[: len(words)])))
        return mix((upto[at + n] - upto[at]) * down[at], n)


def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of documents (columns key, text): (words, document starts, keys, positions, document of each
    position); positions are minimisers with CORE words of their document from there."""
    parts, keys, n = [], [], 0

    def done():
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        words = np.concatenate(parts)
        at = minimisers(words) if len(words) >= GRAM else np.zeros(0, np.int64)
        doc = np.searchsorted(starts, at, "right") - 1
        ok = at + CORE <= starts[doc + 1]
        return words, starts, np.array(keys, np.int64), at[ok], doc[ok]

    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1)):
            w = word_hashes(text.as_py())
            if len(w) < PASSAGE:
                continue
            parts.append(w)
            keys.append(key)
            n += len(w)
            if n > BLOCK:
                yield done()
                parts, keys, n = [], [], 0
    if n:
        yield done()


def _around(words: np.ndarray, starts: np.ndarray, at: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The RIGHT words after each core and the LEFT before it, nearest first, as 32-bit hashes; 0 outside."""
    offsets = np.concatenate((CORE + np.arange(RIGHT), -1 - np.arange(LEFT)))
    where = at[:, None] + offsets
    inside = (where >= starts[doc][:, None]) & (where < starts[doc + 1][:, None])
    near = (words[np.clip(where, 0, len(words) - 1)] >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return np.where(inside, near, 0).astype(">u4")


def _window_ids(core: np.ndarray, around: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = core.copy()
        for j in range(around.shape[1]):
            h = h * _STEP + around[:, j].astype(np.uint64)
    return mix(h, 3)


def compare(group: np.ndarray, around: np.ndarray, low: np.ndarray, high: np.ndarray):
    """Compares the windows of each group exactly, in memory linear in them.

    A match of PASSAGE words has PASSAGE - CORE more equal words beside the core, some before the
    position and the others after the core: for each way to split them, windows are grouped by the
    words that the split names, and a group of two documents is a match of all its members.

    low, high: least and greatest document of each window.  Returns for each window how far its
    matches reach (left, right of the position; 0 for none) and the least of all documents that
    match it, its own included."""
    n, more = len(group), PASSAGE - CORE
    left, right, least = np.zeros(n, np.int32), np.zeros(n, np.int32), low.copy()
    right_words, left_words = around[:, :RIGHT], around[:, RIGHT:]
    whole_l, whole_r = (left_words != 0).cumprod(1).sum(1), (right_words != 0).cumprod(1).sum(1)
    up, _ = _powers(1 << 16)

    def before(ln):
        return left_words[:, ln].astype(np.uint64) * up[ln + 1]

    def after(rn):
        return right_words[:, rn].astype(np.uint64) * up[rn + 1]

    def group_by(ln, rn, left_hash, right_hash):
        use = np.flatnonzero((whole_l >= ln) & (whole_r >= rn))
        if not len(use):
            return
        ids = pair(pair(group[use], left_hash[use]), right_hash[use])
        order = np.argsort(ids)
        use, ids = use[order], ids[order]
        first = np.flatnonzero(np.concatenate(([True], ids[1:] != ids[:-1])))
        lo, hi = np.minimum.reduceat(low[use], first), np.maximum.reduceat(high[use], first)
        sizes = np.diff(np.append(first, len(use)))
        hit = np.repeat(lo != hi, sizes)
        i = use[hit]
        left[i] = np.maximum(left[i], ln)  # every match holds the position: their union reaches as far as each side's longest
        right[i] = np.maximum(right[i], CORE + rn)
        least[i] = np.minimum(least[i], np.repeat(lo, sizes)[hit])

    with np.errstate(over="ignore"):
        none = np.zeros(n, np.uint64)
        l_hash, r_hash = none.copy(), none.copy()
        for rn in range(RIGHT):  # on the right alone, as far as is carried
            r_hash += after(rn)
            if rn + 1 > more:
                group_by(0, rn + 1, none, r_hash)
        for rn in range(RIGHT - 1, more - 1, -1):
            r_hash -= after(rn)
        for ln in range(LEFT + 1):
            rn = max(0, more - ln)
            group_by(ln, rn, l_hash, r_hash)
            if ln < LEFT:
                l_hash += before(ln)
            if rn:
                r_hash -= after(rn - 1)
    return left, right, least


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, first_word, end_word, words, earliest_id``: each maximal run of words of a document
    in which every word belongs to a passage of PASSAGE words or more that another document has.

    ``earliest_id`` is the least id of all documents that have a passage of the run, the document's
    own included, so the first occurrence is the one that names itself.  Documents without such a passage, null and
    empty texts among them, have no row; rows of one id are one document; a row without an id has a
    key from its text above all ids, and null in these columns.  Other columns are not read.
    """
    rows = docs.select(row_key(col(id_col), col(text_col)).alias("key"), col(text_col).cast("string").alias("text")).where("text is not null")
    sc, ranges = docs.sparkSession.sparkContext, ranges_for(rows, "text")

    def count(batches):
        for seq, (words, _, _, at, _) in enumerate(suffixes(batches)):
            h, n, _ = summed(runs(words, at, CORE), np.ones(len(at), np.int64))
            yield batch(list(split_sorted(seq, h, ranges, n.astype(np.uint32))))

    def add(p, parts):
        h, n, _ = summed(np.concatenate([a[0] for _, a in parts]), np.concatenate([a[1].astype(np.int64) for _, a in parts]))
        return pa.table({"h": h[n > 1].view(np.int64), "n": n[n > 1]})

    cores = staged(reduced(rows.mapInArrow(count, PACKED), add, "h long, n long"), "cores")
    again = sc.broadcast(bitmap(cores, "h", 25))
    often = sc.broadcast(bitmap(cores.where(F.col("n") >= FREQUENT), "h", 22))

    def candidates(batches):
        for words, starts, keys, at, doc in suffixes(batches):
            core = runs(words, at, CORE)
            ok = in_bitmap(again.value, core)
            core, at, doc = core[ok], at[ok], doc[ok]
            yield words, starts, keys, at, doc, core, _around(words, starts, at, doc)

    def windows(batches):
        for _, starts, keys, at, doc, core, around in candidates(batches):
            wid, key = _window_ids(core, around), keys[doc]
            order = np.lexsort((key, wid))  # a window once for each run of documents
            w, k = wid[order], key[order]
            first = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(w)) - 1
            i, low, high = order[first], k[first] if len(k) else k, k[last] if len(k) else k
            hot = in_bitmap(often.value, core[i])
            views = [(i[~hot], core[i[~hot]], low[~hot], high[~hot])]
            for side in (around[i, :SIDE], around[i, RIGHT : RIGHT + SIDE]):
                full = hot & (side != 0).all(1)
                views.append((i[full], _window_ids(core[i[full]], side[full]), low[full], high[full]))
            for j, group, lo, hi in views:
                yield pa.RecordBatch.from_arrays([pa.array(group.view(np.int64)), pa.array(wid[j].view(np.int64)), pa.array([x.tobytes() for x in around[j]], pa.binary()), pa.array(lo), pa.array(hi)], names=["grp", "wid", "around", "low", "high"])

    def meet(batches):
        got = [[np.asarray(b.column(0)).view(np.uint64), np.asarray(b.column(1)).view(np.uint64), np.frombuffer(b"".join(b.column(2).to_pylist()), ">u4").reshape(-1, LEFT + RIGHT), np.asarray(b.column(3)), np.asarray(b.column(4))] for b in batches if b.num_rows]
        if not got:
            return
        group, wid, around, low, high = (np.concatenate(x) for x in zip(*got))
        order = np.lexsort((wid, group))
        g, w = group[order], wid[order]
        first = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (w[1:] != w[:-1]))))
        i = order[first]
        low, high = np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first)
        left, right, least = compare(group[i], around[i], low, high)
        hit = left + right > 0
        yield pa.RecordBatch.from_arrays([pa.array(wid[i][hit].view(np.int64)), pa.array(left[hit]), pa.array(right[hit]), pa.array(least[hit])], names=["wid", "lw", "rw", "least"])

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = cores.agg(F.sum("n")).first()[0] or 0
    kinds = rows.mapInArrow(windows, "grp long, wid long, around binary, low long, high long")
    found = kinds.repartition(max(n, total // 150_000 + 1), "grp").mapInArrow(meet, "wid long, lw int, rw int, least long")
    found = found.groupBy("wid").agg(F.max("lw").alias("lw"), F.max("rw").alias("rw"), F.min("least").alias("least"))
    found = staged(found, "matches")
    hits = sc.broadcast(bitmap(found, "wid", 25))

    def positions(batches):
        for _, starts, keys, at, doc, core, around in candidates(batches):
            wid = _window_ids(core, around)
            ok = in_bitmap(hits.value, wid)
            yield pa.RecordBatch.from_arrays([pa.array(wid[ok].view(np.int64)), pa.array(keys[doc[ok]]), pa.array((at - starts[doc])[ok])], names=["wid", "key", "at"])

    places = rows.mapInArrow(positions, "wid long, key long, at long").join(found, "wid")
    spans = places.select("key", (F.col("at") - F.col("lw")).alias("lo"), (F.col("at") + F.col("rw")).alias("hi"), "least").distinct()
    by_doc = Window.partitionBy("key").orderBy("lo", "hi")
    before = F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("opens", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1)))
    spans = spans.withColumn("run", F.sum("opens").over(by_doc.rowsBetween(Window.unboundedPreceding, 0)))
    out = spans.groupBy("key", "run").agg(F.min("lo").alias("first_word"), F.max("hi").alias("end_word"), F.min("least").alias("earliest"))
    id_of = lambda c: F.when(F.col(c) < NO_ID, F.col(c))
    return out.select(id_of("key").alias("doc_id"), "first_word", "end_word", (F.col("end_word") - F.col("first_word")).alias("words"), id_of("earliest").alias("earliest_id"))


def op3_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repeated passages of all documents: ``doc_id, first_word, end_word, words, earliest_id``.
    Nulls, short texts, repeated rows and empty tables as in ``repeated_passages``."""
    return repeated_passages(documents(spark, sf_dir))
