"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's size is its number of words.  Sources are ordered by code point, null last, and
weigh 1, 2, 3, repeating.  They share the sum of all sizes by weight; a target stops at ``cap``
times its source's size, and the excess is shared anew until none is above (water filling: a
target is ``min(cap * size, level * weight)`` for the one level at which the targets add up).

A target of ``e`` whole epochs and a rest takes every document of the source ``e`` times and then
selects documents for the rest: each has the key ``-ln(u) / quality`` with ``u`` from a hash of
its id, and the documents of least key are taken until their sizes reach the rest (the last one
only if most of it fits).  ``quality`` is between 0.25 and 1.25: a quarter plus the share of
letters and spaces in the text.

No source is sorted in one task: two histograms over the key narrow the cut down to about one in
2^24 of the source's rows, and only these are ordered.  What is decided for a source is one
threshold, so the texts themselves are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, col, documents, fresh, staged

CELLS = 4096


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    n = F.length(text)
    letters = F.length(F.regexp_replace(text, r"[^\p{L} ]", ""))
    return F.coalesce(F.lit(0.25) + F.when(n > 0, letters / n), F.lit(0.25))


def sample_key(doc_id: Column, text: Column, seed: int) -> Column:
    """-ln(u) / quality; u in (0, 1) from 48 bits of md5(seed:id), the text standing in for a null id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), text, F.lit("")))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)
    return -F.log(u) / quality_weight(text)


def _cell(key: Column, levels: int) -> Column:
    """The key's cell of CELLS**levels, monotone in the key."""
    return F.least(F.lit(CELLS**levels - 1), F.floor((1 - F.exp(-key * 0.8)) * float(CELLS**levels))).cast("long")


def source_targets(sizes: DataFrame, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """(source, size) -> (source, source_size, target); a row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    full = Window.orderBy(F.col("fill"), F.col("source").asc_nulls_last())
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    return (
        sizes.select("source", F.col("size").alias("source_size"), w.alias("w"))
        .withColumn("fill", F.col("source_size") * cap / F.col("w"))
        .withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0.0)))
        .withColumn("left_w", F.sum("w").over(all_rows) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level", F.max(F.when(F.col("left") / F.col("left_w") <= F.col("fill"), F.col("left") / F.col("left_w"))).over(all_rows))
        .select("source", "source_size", F.round(F.least(F.col("source_size") * cap, F.coalesce("level", F.lit(float("inf"))) * F.col("w")), 6).alias("target"))
    )


def source_cuts(slim: DataFrame, cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """What is decided for each source: ``source, source_size, target, epochs, cut_key, cut_id``.

    slim: ``id, source, size, key``.  The source's documents are taken ``epochs`` times, and once
    more if ``(key, id)`` is at most ``(cut_key, cut_id)`` (nulls: none more).
    """
    sizes = slim.groupBy("source").agg(F.sum("size").cast("long").alias("size"))
    goals = source_targets(sizes, cap, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + 1e-9)).otherwise(0).cast("long")
    goals = goals.withColumn("epochs", whole).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size")))
    goals = staged(goals, "mix-goals")

    def crossing(cells: DataFrame, rest: DataFrame) -> DataFrame:
        """The cell of each source in which the running sum of sizes reaches the rest."""
        run = Window.partitionBy("source").orderBy("cell")
        sums = cells.groupBy("source", "cell").agg(F.sum("size").alias("size"))
        sums = sums.withColumn("upto", F.sum("size").over(run))
        r = rest.select(F.col("source").alias("s"), "rest")
        hit = sums.join(r, F.col("source").eqNullSafe(F.col("s"))).where((F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
        return hit.select("source", F.col("cell").alias("hit"), (F.col("rest") - (F.col("upto") - F.col("size"))).alias("rest"))

    def within(rows: DataFrame, cells: DataFrame) -> DataFrame:
        c = cells.select(F.col("source").alias("s"), "hit", "rest")
        return rows.join(c, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("hit"))).drop("s", "hit", "cell")

    sized = slim.where("size > 0")
    first = staged(crossing(sized.withColumn("cell", _cell(F.col("key"), 1)), goals), "mix-cells")
    inner = within(sized.withColumn("cell", _cell(F.col("key"), 1)), first).withColumn("cell", _cell(F.col("key"), 2))
    second = staged(crossing(inner.drop("rest"), first), "mix-cells")
    last = within(inner.drop("rest"), second)
    order = Window.partitionBy("source").orderBy("key", F.col("id").asc_nulls_first())
    # the frame is by range: rows of equal (key, id) are one document's and go together
    last = last.withColumn("upto", F.sum("size").over(order))
    last = last.withColumn("own", F.sum("size").over(Window.partitionBy("source", "key", "id")))
    fits = last.where(F.col("upto") - F.col("own") / 2 <= F.col("rest"))
    top = fits.groupBy("source").agg(F.max(F.struct("key", "id")).alias("top"))
    t = top.select(F.col("source").alias("ts"), "top")
    e = second.select(F.col("source").alias("es"), F.col("hit").alias("cell2"))  # cells below it are taken whole
    g = goals.drop("rest")
    return (
        g.join(e, F.col("source").eqNullSafe(F.col("es")), "left").join(t, F.col("source").eqNullSafe(F.col("ts")), "left")
        .select("source", "source_size", "target", "epochs", "cell2", F.col("top.key").alias("cut_key"), F.col("top.id").alias("cut_id"))
    )


def copies(size: Column, key: Column, doc_id: Column, cut: str = "cut") -> Column:
    """How often a document is taken; ``cut`` names a struct of its source's ``source_cuts``."""
    cell, top_cell, top_key = _cell(key, 2), F.col(f"{cut}.cell2"), F.col(f"{cut}.cut_key")
    at = (cell == top_cell) & ((key < top_key) | ((key == top_key) & (doc_id.isNull() | (doc_id <= F.col(f"{cut}.cut_id")))))
    more = F.coalesce((cell < top_cell) | at, F.lit(False))
    return F.when(size > 0, F.col(f"{cut}.epochs") + more.cast("long")).otherwise(F.lit(0)).cast("long")


def slim_table(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    text = col(text_col)
    return docs.select(
        col(id_col).cast("long").alias("id"), col(source_col).cast("string").alias("source"),
        word_count(text).alias("size"), sample_key(col(id_col), text, seed).alias("key"),
    )


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> DataFrame:
    """A row per input row: ``doc_id, size, source_size, target, epochs, copies, taken, source``.

    Null and empty texts have size 0 and are never taken; a null source is a source of its own,
    ordered last.  Repeated rows of one id and size share a key and are taken or left together.
    An empty table gives no rows.  Other columns of ``docs`` are not read.
    """
    slim = staged(slim_table(docs, id_col, text_col, source_col, seed), "mix-slim")
    cuts = staged(source_cuts(slim, cap, weights), "mix-cuts")
    cuts = cuts.select(F.struct(*cuts.columns).alias("cut"))
    both = slim.join(cuts, F.col("source").eqNullSafe(F.col("cut.source")))
    both = both.withColumn("copies", copies(F.col("size"), F.col("key"), F.col("id")))
    return both.select(F.col("id").alias("doc_id"), "size", "cut.source_size", "cut.target", "cut.epochs", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    cap: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 20) -> DataFrame:
    """The mix itself: each row of ``docs``, all its columns, as many times as it is taken."""
    slim = staged(slim_table(docs, id_col, text_col, source_col, seed), "mix-slim")
    cuts = staged(source_cuts(slim, cap, weights), "mix-cuts")
    names = fresh(docs, "mix_size", "mix_key", "mix_n", "mix_copy", "mix_cut")
    size, key, n, copy, cut = names
    out = docs.withColumns({size: word_count(col(text_col)), key: sample_key(col(id_col), col(text_col), seed)})
    cuts = cuts.select(F.struct(*cuts.columns).alias(cut))
    out = out.join(cuts, col(source_col).cast("string").eqNullSafe(F.col(f"{cut}.source")))
    out = out.withColumn(n, copies(col(size), col(key), col(id_col).cast("long"), cut).cast("int")).where(col(n) > 0)
    out = out.withColumn(copy, F.explode(F.sequence(F.lit(1), col(n))))
    return out.select(*[col(c) for c in docs.columns])


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document.  Nulls, ties, repeated rows and empty tables
    as in ``mix_sources``."""
    out = mix_sources(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         -ln((('0x' || substr(md5('20:' || coalesce(doc_id::VARCHAR, text, '')), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)
           / coalesce(0.25::DOUBLE + CASE WHEN length(text) > 0 THEN length(regexp_replace(text, '[^\p{L} ]', '', 'g'))::DOUBLE / length(text) END, 0.25::DOUBLE) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::DOUBLE AS source_size,
         ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, 3 * source_size / w AS fill,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS l,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS lw
  FROM s WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, round(least(3 * source_size, coalesce(max(CASE WHEN l / lw <= fill THEN l / lw END) OVER (), 'inf'::DOUBLE) * w), 6) AS target FROM f
), e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END AS epochs FROM t
), p AS (
  SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, greatest(0, e.target - e.epochs * e.source_size) AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id) - d.size / 2.0::DOUBLE AS mid
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
)
SELECT doc_id, size, source_size::BIGINT AS source_size, target,
       (CASE WHEN size > 0 THEN size * (epochs + CASE WHEN mid <= rest THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken
FROM p
"""
