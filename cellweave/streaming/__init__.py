"""Points that move as a stream: every micro-batch is a step of a ``Moving`` tessellation."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.moving import Moving
from ..plans import staged

LOG = "batch_id long, n long, state string"


class Follower:
    """Applies batches of moved points (``cell_id, x, y, z[, step]``) to a tessellation.

    A repair needs the positions of all seeds, so a batch is completed from the last ones; of
    several rows of a seed the one of the greatest ``step`` counts, and of those (or without the
    column) the one of the greatest x, then y, then z.  Rows of unknown seeds, and rows with nulls,
    are left out.  ``steps`` keeps each batch's counts.

    With ``folder``, which the driver and executors share, positions and cells are written there
    after each batch, and then a line of a log.  A new driver that names the same folder goes on
    behind the last batch of the log: a batch that had not got that far is applied again to what was
    before it, one that had is skipped.
    """

    def __init__(self, moving: Moving, seeds: DataFrame, on_step: Callable[[DataFrame, dict, int], None] | None = None, folder: str | None = None):
        self.moving, self.on_step, self.steps, self.done = moving, on_step, [], -1
        self.folder, self.spark = folder and folder.rstrip("/"), seeds.sparkSession
        if not self._resumed():
            self.positions = staged(seeds.select("cell_id", "x", "y", "z"), "positions")

    def _log(self) -> str:
        return f"{self.folder}/log"

    def _resumed(self) -> bool:
        sc = self.spark.sparkContext
        if not self.folder:
            return False
        at = sc._jvm.org.apache.hadoop.fs.Path(self._log())
        if not at.getFileSystem(sc._jsc.hadoopConfiguration()).exists(at):
            return False
        last = self.spark.read.schema(LOG).parquet(self._log()).orderBy(F.desc("batch_id")).first()
        if last is None:
            return False
        self.done, self.moving.n, self.moving.spacing = last["batch_id"], last["n"], self.moving.box.spacing(last["n"])
        self.positions = self.spark.read.parquet(f"{last['state']}/positions")
        self.moving.cells = self.spark.read.parquet(f"{last['state']}/cells")
        return True

    def _kept(self, batch_id: int) -> None:
        state = f"{self.folder}/batch-{batch_id}-{uuid.uuid4().hex}"
        self.positions.write.parquet(f"{state}/positions")
        self.moving.cells.write.parquet(f"{state}/cells")
        self.spark.createDataFrame([(batch_id, self.moving.n, state)], LOG).write.mode("append").parquet(self._log())

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        if batch_id <= self.done:  # a batch that is given again after a restart of the query
            return
        order = [F.desc("step")] if "step" in batch.columns else []
        ranked = Window.partitionBy("cell_id").orderBy(*order, F.desc("x"), F.desc("y"), F.desc("z"))
        last = batch.dropna(subset=["cell_id", "x", "y", "z"]).withColumn("n", F.row_number().over(ranked)).where("n = 1")
        last = last.select("cell_id", *[F.col(c).alias(f"new_{c}") for c in "xyz"])
        now = self.positions.join(last, "cell_id", "left")
        now = now.select("cell_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in "xyz"])
        self.positions = staged(now, "positions")
        stats = self.moving.step(self.positions)
        if self.folder:
            self._kept(batch_id)
        self.steps.append(stats)
        self.done = batch_id
        if self.on_step:
            self.on_step(self.moving.cells, stats, batch_id)


def follow(stream: DataFrame, follower: Follower, checkpoint: str, **options: str) -> StreamingQuery:
    """Starts the query; ``checkpoint`` is a folder that the driver and executors share."""
    return stream.writeStream.options(**options).option("checkpointLocation", checkpoint).foreachBatch(follower.apply).start()


def latest_moves(events: DataFrame, n_seeds: int, lateness: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """From an event stream (``event_id, ts, value``), how far each seed is moved in each window of
    event time: ``window, cell_id, moved``.  Late events within ``lateness`` still count."""
    e = events.withWatermark("ts", lateness).withColumn("cell_id", F.pmod("event_id", F.lit(n_seeds)))
    return e.groupBy(F.window("ts", every), "cell_id").agg(F.sum("value").alias("moved"))
