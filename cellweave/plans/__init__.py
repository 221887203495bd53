"""How tables are laid out: staging, blocks with halos, spatial joins."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..box import Box
from ..functions import bin_id, bin_index, min_image


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a local folder is set only where that is unset on a
    single machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if sc.master.split("[")[0] != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        named = os.path.join(tempfile.gettempdir(), f"cellweave-{uuid.uuid4().hex}")
        sc.setCheckpointDir(named)
    return named


def staged(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder, read again: the lineage ends there and no executor
    holds the only copy."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/cellweave-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Deletes what ``staged`` wrote, for tables that no later plan reads."""
    sc = df.sparkSession.sparkContext
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/cellweave-" in folder:
            at = sc._jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def block_grid(box: Box, n: int, each: int, cores: int = 8) -> tuple[int, int, int]:
    """Blocks per axis: about ``each`` seeds in one, fewer while there are less blocks than cores."""
    return box.bins(n, max(64, min(each, n // max(1, 2 * cores))))


def _modulo(n: int):
    return lambda k: F.pmod(k, F.lit(n))


def replicated(seeds: DataFrame, box: Box, grid: tuple[int, int, int], reach: float) -> DataFrame:
    """A row for each block whose box, widened by ``reach``, holds the seed or an image of it, with
    ``block`` and ``is_owned``.  A block gets a seed once, whatever images fall near it."""
    axes = []
    for c, edge, n in zip("xyz", box.edges.tolist(), grid):
        width = edge / n
        if 2 * reach >= edge - width:
            axes.append(F.sequence(F.lit(0), F.lit(n - 1)))
            continue
        low, high = F.floor((F.col(c) - reach) / width).cast("int"), F.floor((F.col(c) + reach) / width).cast("int")
        axes.append(F.array_distinct(F.transform(F.sequence(low, high), _modulo(n))))
    own = [bin_index(F.col(c), e, n) for c, e, n in zip("xyz", box.edges.tolist(), grid)]
    out = seeds.withColumn("own_block", own[0].cast("long") + grid[0] * (own[1] + F.lit(grid[1]).cast("long") * own[2]))
    for c, axis in zip("ijk", axes):
        out = out.withColumn(f"block_{c}", F.explode(axis))
    block = F.col("block_i").cast("long") + grid[0] * (F.col("block_j") + F.lit(grid[1]).cast("long") * F.col("block_k"))
    return out.withColumn("block", block).withColumn("is_owned", F.col("block") == F.col("own_block")).drop("own_block", "block_i", "block_j", "block_k")


def neighbour_pairs(a: DataFrame, b: DataFrame, box: Box, radius: float) -> DataFrame:
    """Pairs within ``radius`` (a range join): ``cell_id, nbr_id, rx, ry, rz, d2``.

    Each point of ``a`` is exploded into the bins round it, which turns the distance predicate into
    an equality of bins that shuffles, plus an exact filter."""
    grid = tuple(max(1, int(e / radius)) for e in box.edges)
    near = b.select(F.col("cell_id").alias("nbr_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("z").alias("nz"))
    near = near.withColumn("bin", bin_id(F.col("nx"), F.col("ny"), F.col("nz"), box, grid))
    home = a.select("cell_id", "x", "y", "z")
    at = []
    for c, e, n in zip("xyz", box.edges.tolist(), grid):
        i = bin_index(F.col(c), e, n)
        at.append(F.array_distinct(F.array(*[F.pmod(i + k, F.lit(n)) for k in (-1, 0, 1)])))
    for c, axis in zip("ijk", at):
        home = home.withColumn(f"b{c}", F.explode(axis))
    home = home.withColumn("bin", F.col("bi").cast("long") + grid[0] * (F.col("bj") + F.lit(grid[1]).cast("long") * F.col("bk"))).drop("bi", "bj", "bk")
    both = home.join(near, "bin").where(F.col("cell_id") != F.col("nbr_id"))
    for c, e in zip("xyz", box.edges.tolist()):
        both = both.withColumn(f"r{c}", min_image(F.col(f"n{c}") - F.col(c), e))
    both = both.withColumn("d2", F.col("rx") * F.col("rx") + F.col("ry") * F.col("ry") + F.col("rz") * F.col("rz"))
    return both.where(F.col("d2") <= radius * radius).select("cell_id", "nbr_id", "rx", "ry", "rz", "d2")


def nearest(a: DataFrame, b: DataFrame, box: Box, k: int, n: int) -> DataFrame:
    """The ``k`` nearest of ``b`` for each of ``a``, closest first, ties by id: ``rank`` from 1.

    The radius starts where ``k`` are expected and doubles for the points that found fewer."""
    radius, rest, parts = box.spacing(n) * (0.75 * (k + 1)) ** (1 / 3), a, []
    half_diagonal = float((box.edges**2).sum() ** 0.5) / 2
    while True:
        pairs = neighbour_pairs(rest, b, box, min(radius, half_diagonal))
        order = Window.partitionBy("cell_id").orderBy("d2", "nbr_id")
        got = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if radius >= half_diagonal:
            parts.append(got)
            break
        got = staged(got, "nearest")
        full = got.where(F.col("rank") == k).select("cell_id")
        parts.append(got.join(full, "cell_id", "left_semi"))
        rest = staged(rest.join(full, "cell_id", "left_anti"), "nearest-rest")
        if rest.isEmpty():
            break
        radius *= 2
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def reciprocal(facets: DataFrame) -> DataFrame:
    """Each facet between seeds with the other cell's record of it as ``back_*``; nulls if absent."""
    back = facets.select(F.col("cell_id").alias("back_cell"), F.col("nbr_id").alias("back_nbr"), *[F.col(c).alias(f"back_{c}") for c in facets.columns if c not in ("cell_id", "nbr_id")])
    return facets.where("nbr_id >= 0").join(back, (F.col("cell_id") == F.col("back_nbr")) & (F.col("nbr_id") == F.col("back_cell")), "left").drop("back_cell", "back_nbr")


def gather_halo(seeds: DataFrame, box: Box, grid: tuple[int, int, int], reach: float) -> DataFrame:
    """What each block owns and the ghosts within ``reach`` of it."""
    return replicated(seeds, box, grid, reach)


def refresh_halo(halo: DataFrame, moved: DataFrame) -> DataFrame:
    """New positions on a halo's replication, which stays as it was."""
    return halo.drop("x", "y", "z").join(moved.select("cell_id", "x", "y", "z"), "cell_id")


def owner(x: Column, y: Column, z: Column, box: Box, grid: tuple[int, int, int]) -> Column:
    return bin_id(x, y, z, box, grid)


def candidate_lists(a: DataFrame, b: DataFrame, box: Box, radius: float) -> DataFrame:
    """``cell_id, candidates``: the ids, ascending, of the points of ``b`` within ``radius`` of each of ``a``."""
    pairs = neighbour_pairs(a, b, box, radius)
    return pairs.groupBy("cell_id").agg(F.sort_array(F.collect_list("nbr_id")).alias("candidates"))


def exclusive_scan(df: DataFrame, key: str, value: str, out: str, width: int = 1 << 16) -> DataFrame:
    """Adds the sum of ``value`` over all rows with a smaller ``key`` (a long, once each).

    Sums of ranges of ``width`` keys are scanned, a row for each, and rows within their range."""
    part = F.floor(F.col(key) / width)
    sums = df.groupBy(part.alias("scan_of")).agg(F.sum(value).alias("scan_sum"))
    ahead = sums.select("scan_of", (F.sum("scan_sum").over(Window.orderBy("scan_of")) - F.col("scan_sum")).alias("scan_ahead"))
    rows = df.withColumn("scan_part", part).join(ahead, F.col("scan_part") == F.col("scan_of"))
    within = F.sum(value).over(Window.partitionBy("scan_part").orderBy(key)) - F.col(value)
    return rows.withColumn(out, F.col("scan_ahead") + within).drop("scan_part", "scan_of", "scan_ahead")
