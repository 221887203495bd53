"""Line dedup with content-defined chunks of lines.

A chunk ends after a line at which a rolling hash over the hashes of the last ``WINDOW`` lines
meets a condition, so boundaries move with the content when lines are inserted before it.  Chunks of
two lines or more that occur again anywhere, in another document or further down in the same one,
are removed but for the first occurrence (least id, then least position).  Hashes only propose:
chunks are removed where their bytes are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bitmap, col, documents, fresh, in_bitmap, lean, row_key, sift, staged

#: Lines under the rolling hash, one boundary in so many lines, and least lines of a chunk.
WINDOW, EVERY, LEAST = 2, 3, 2
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def chunk_ends(lines: list[str]) -> list[int]:
    """Ends (exclusive) of the chunks of a text's lines; the last may be shorter than LEAST."""
    h = np.array([xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) for x in lines], np.uint64)
    rolling = np.zeros(len(h), np.uint64)
    with np.errstate(over="ignore"):
        for back in range(WINDOW):
            part = h[: len(h) - back]
            rolling[back:] += part * _FACTOR ** np.uint64(back)
        rolling = (rolling ^ (rolling >> np.uint64(29))) * _FACTOR
    stops, last = [], 0
    for i in np.flatnonzero((rolling >> np.uint64(33)) % np.uint64(EVERY) == 0) + 1:
        if i - last >= LEAST:
            stops.append(int(i))
            last = int(i)
    if last < len(lines):
        stops.append(len(lines))
    return stops


def chunks(text: str) -> Iterator[tuple[int, int, int, str]]:
    """(first line, end, hash as signed long, text) of each chunk of at least LEAST lines."""
    lines, last = text.split("\n"), 0
    for end in chunk_ends(lines):
        if end - last >= LEAST:
            body = "\n".join(lines[last:end])
            h = xxhash.xxh64_intdigest(body.encode("utf-8", "surrogatepass"))
            yield last, end, h - (1 << 64) if h >> 63 else h, body
        last = end


def _without(text: str, gone: set[tuple[int, int]]) -> tuple[str, int, int]:
    """(text without the chunks named by first line and hash, lines removed, chunks removed)."""
    lines, drop, n = text.split("\n"), set(), 0
    for first, end, h, _ in chunks(text):
        if (first, h) in gone:
            drop.update(range(first, end))
            n += 1
    return "\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else text, len(drop), n


def _chunk_rows(docs: DataFrame, id_col: str, text_col: str, only: np.ndarray | None) -> DataFrame:
    """``h, key, first[, body]``: with ``only``, the chunks whose hash is in that bitmap, with text."""
    rows = docs.select(row_key(col(id_col), col(text_col)).alias("key"), col(text_col).cast("string").alias("text")).where("text is not null")
    screen = None if only is None else docs.sparkSession.sparkContext.broadcast(only)
    names = ["h", "key", "first"] + ["body"] * (only is not None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            held = 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                got = list(chunks(text.as_py()))
                if screen is not None and got:
                    ok = in_bitmap(screen.value, np.array([c[2] for c in got], np.int64).view(np.uint64))
                    got = [c for c, use in zip(got, ok) if use]
                for first, _, h, body in got:
                    for o, x in zip(out, (h, key, first, body)):
                        o.append(x)
                    held += len(body)
                if held > 8 << 20 or len(out[0]) > 50_000:
                    yield as_batch(out)
                    out, held = ([], [], [], []), 0
            yield as_batch(out)

    def as_batch(out) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out[: len(names)], kinds)], names=names)

    return rows.mapInArrow(lean(run), "h long, key long, first int" + ", body string" * (only is not None))


def repeated_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, first, h`` of each chunk to be removed."""
    rows = staged(_chunk_rows(docs, id_col, text_col, None), "chunks")
    again = staged(rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "repeated")
    # the texts of chunks whose hash repeats, screened before the shuffle and joined exactly after it
    bodies = _chunk_rows(docs, id_col, text_col, bitmap(again, "h")).join(again, "h", "left_semi")
    bodies = staged(bodies, "bodies")
    equal = bodies.groupBy("h", "body").agg(F.count("*").alias("n"), F.min(F.struct("key", "first")).alias("origin"))
    same = staged(equal.groupBy("h").agg(F.count("*").alias("texts"), F.min("origin").alias("origin")), "origins")
    # one text to a hash, which is all but certain: the rows without their texts are enough
    one = same.where("texts = 1").select(F.col("h").alias("oh"), F.col("origin.key").alias("okey"), F.col("origin.first").alias("ofirst"))
    gone = bodies.select("h", "key", "first").join(one, F.col("h") == F.col("oh"))
    gone = gone.where((F.col("key") != F.col("okey")) | (F.col("first") != F.col("ofirst"))).select("key", "first", "h")
    # several texts with one hash: each text apart
    many = same.where("texts > 1").select("h")
    if not many.isEmpty():
        split = bodies.join(many, "h", "left_semi")
        by_text = split.groupBy("h", "body").agg(F.min(F.struct("key", "first")).alias("origin")).select(F.col("h").alias("oh"), F.col("body").alias("obody"), "origin")
        more = split.join(by_text, (F.col("h") == F.col("oh")) & (F.col("body") == F.col("obody")))
        gone = gone.union(more.where(F.struct("key", "first") != F.col("origin")).select("key", "first", "h"))
    return gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated chunks out of its texts, and ``n_lines, removed_lines,
    removed_chunks`` (replacing columns of these names).

    A null text stays null with 0 lines; an empty one has one empty line.  Rows that share an id
    are one document and are treated alike, so a repeated row keeps what its twin keeps.  A row
    without an id has a key from its text, above all ids.  An empty table stays empty.
    """
    gone = repeated_chunks(docs, id_col, text_col).groupBy("key").agg(F.collect_set(F.struct("first", "h")).alias("gone"))
    gone = staged(gone, "gone")
    # only documents that lose lines are shuffled, and the few that share their bit of a fixed-size bitmap
    screen = bitmap(gone.select(F.xxhash64("key").alias("h")), "h")
    key, mark, text = fresh(docs, "dedup_key", "dedup_mark", "dedup_text")
    added = ["n_lines", "removed_lines", "removed_chunks"]
    names = [c for c in docs.columns if c not in added]
    rest = [c for c in names if c != text_col]
    wide = docs.select(*[col(c) for c in rest], row_key(col(id_col), col(text_col)).alias(key), col(text_col).cast("string").alias(text)).withColumn(mark, F.xxhash64(col(key)))
    schema = T.StructType([*[docs.schema[c] for c in rest], T.StructField(text_col, T.StringType()), *[T.StructField(c, T.IntegerType()) for c in added]])

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], ([], [], [])
            for body, drop in zip(batch.column(len(rest)), batch.column(len(rest) + 1)):
                body, drop = body.as_py(), drop.as_py()
                new, lines, n = (body, 0, 0) if body is None or not drop else _without(body, {(d["first"], d["h"]) for d in drop})
                texts.append(new)
                for c, x in zip(counts, (0 if body is None else body.count("\n") + 1, lines, n)):
                    c.append(x)
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(rest))], pa.array(texts, pa.string()), *[pa.array(c, pa.int32()) for c in counts]], names=schema.names)

    body, none = col(text), F.lit(0).cast("int")
    lines = F.coalesce(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1, none).cast("int")
    same = sift(wide, mark, screen, False).select(*[col(c) for c in rest], body.alias(text_col), lines.alias(added[0]), none.alias(added[1]), none.alias(added[2]))
    was = fresh(docs, "dedup_gone")[0]
    losing = sift(wide, mark, screen, True)
    # merged at every size: the plan doesn't turn with the number of removed chunks
    losing = losing.join(gone.select(F.col("key").alias("gone_of"), F.col("gone").alias(was)).hint("merge"), col(key) == F.col("gone_of"), "left")
    out = same.union(losing.select(*[col(c) for c in rest], col(text), col(was)).mapInArrow(lean(rewrite), schema))
    return out.select(*[col(c) for c in names], *added)


def op2_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated line chunks: ``doc_id, text, n_lines, removed_lines,
    removed_chunks``.  Nulls, empty texts, repeated rows and empty tables as in ``dedup_lines``."""
    return dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
