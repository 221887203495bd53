"""What the operators of this subpackage share: the shared folder, staging, text rules."""

from __future__ import annotations

import contextlib
import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, in every operator that counts words.
WORD = r"[^\x20\x09-\x0D]+"
#: Stand-in keys of rows without an id lie above all ids.
NO_ID = 1 << 62


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    It is what the session names in ``spark.checkpoint.dir``.  Only where that is unset on a single
    machine (tests) a local folder is made and set as the checkpoint folder; on a cluster it must be
    named.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir()
        if not named:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and the executors share")
            named = os.path.join(tempfile.gettempdir(), f"cellweave-{uuid.uuid4().hex}")
            sc.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def shuffles_end_here(spark: SparkSession) -> Iterator[None]:
    """What runs inside lets go of its shuffle files when its result is written."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def staged(df: DataFrame, what: str, by: str | None = None) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: its lineage ends there,
    it survives lost executors, and the planner knows its size.  With ``by``, each value of that
    column has a folder of its own."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/cellweave-{what}-{uuid.uuid4().hex}"
    with shuffles_end_here(spark):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let_go() -> None:
    """Returns freed memory of this Python worker to the machine; idle workers stay for a while."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over batches that lets go of its memory when it is done."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        let_go()

    return wrapped


def drop_staged(df: DataFrame, only: str = "") -> None:
    """Deletes what ``staged`` wrote, or only its folder of that name; for tables that no later plan reads."""
    spark = df.sparkSession
    root = shared_dir(spark).rstrip("/")
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if folder.endswith(only) and "/cellweave-" in folder and root.split(":")[-1].lstrip("/") in folder:
            at = jvm.org.apache.hadoop.fs.Path(folder)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, one for each of ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def remainder(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n`` (of '' for a null id)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def row_key(doc_id: Column, text: Column) -> Column:
    """The id, or for a null id a number from the text that lies above all ids."""
    return F.coalesce(doc_id.cast("long"), F.lit(NO_ID) + F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(1 << 60)))


def bitmap(df: DataFrame, hash_col: str, log2_bits: int = 24) -> np.ndarray:
    """A bitmap of fixed size, as 64-bit words, in which each hash of ``hash_col`` has set one bit.

    It screens rows before an exact join: whatever the number of hashes, it has ``2**log2_bits``
    bits, and one that fills up lets more rows through but loses none.
    """
    at = F.shiftrightunsigned(col(hash_col), 64 - log2_bits)
    words = df.select(at.alias("b")).groupBy(F.shiftright("b", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("bits"))
    got = words.toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    return out


def in_bitmap(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes (unsigned) have their bit set."""
    log2_bits = int(len(words)).bit_length() + 5
    at = hashes >> np.uint64(64 - log2_bits)
    return (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0


def sift(df: DataFrame, hash_col: str, words: np.ndarray, hit: bool) -> DataFrame:
    """The rows of ``df`` whose hash has its bit set in a ``bitmap``, or hasn't; no shuffle."""
    screen, at = df.sparkSession.sparkContext.broadcast(words), df.columns.index(hash_col)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(in_bitmap(screen.value, np.asarray(batch.column(at)).view(np.uint64)) == hit))

    return df.mapInArrow(run, df.schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")
