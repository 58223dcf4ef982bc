"""Snapshot refresh in micro-batches: each rebuild is a new revision, published by moving a pointer once it is whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Snapshots:
    """Revisions of a table below a folder; the pointer table names the published one."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def revision(self) -> int | None:
        try:
            return self.spark.read.parquet(f"{self.folder}/pointer").agg(F.max("revision")).first()[0]
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def publish(self, df: DataFrame, revision: int) -> None:
        """Write a revision, then append to the pointer. What fails before that leaves the last revision published."""
        df.write.mode("overwrite").parquet(f"{self.folder}/revision={revision}")
        self.spark.range(1).select(F.lit(revision).alias("revision")).write.mode("append").parquet(f"{self.folder}/pointer")

    def read(self, expected: int | None = None) -> DataFrame:
        now = self.revision()
        if now is None:
            raise LookupError("nothing is published")
        if expected is not None and expected != now:
            raise LookupError(f"revision {expected} is gone, {now} is published")
        return self.spark.read.parquet(f"{self.folder}/revision={now}")


def refresh(changes: DataFrame, rebuild: Callable[[DataFrame], DataFrame], snapshots: Snapshots, checkpoint: str, interval: str = "400 milliseconds", once: bool = False):
    """Start a query that rebuilds on each micro-batch of a streaming DataFrame.

    A failed rebuild ends the query with its error; the last snapshot stays published, and as the micro-batch is not
    committed, its changes come again when the query is started anew.
    """

    def batch(df: DataFrame, number: int) -> None:
        if df.limit(1).count():
            snapshots.publish(rebuild(df), number + 1)

    writer = changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()


def latest_frames(frames: DataFrame, revision: int, generation: int) -> DataFrame:
    """Of frames(revision, generation, frame, idx, x, y, z) the last of each node; stale revisions and generations are dropped."""
    live = frames.filter((F.col("revision") == revision) & (F.col("generation") == generation))
    return live.groupBy("idx").agg(F.max_by(F.struct("frame", "x", "y", "z"), "frame").alias("f")).select("idx", "f.*")


def since(events: DataFrame, seq: int, kept: int = 1024) -> DataFrame:
    """Events from a cursor on, of the last `kept` ones."""
    newest = events.agg((F.max("seq") - kept).alias("least"))
    return events.crossJoin(F.broadcast(newest)).filter((F.col("seq") >= seq) & (F.col("seq") > F.col("least"))).drop("least").orderBy("seq")


def keyframed(frames: DataFrame, every: int, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Of frames(idx, frame, ...) each node's every-th in order as it is (keyframe true), the others as what changed since the frame before."""
    order = Window.partitionBy("idx").orderBy("frame")
    out = frames.withColumn("_n", F.row_number().over(order) - 1)
    key = F.col("_n") % every == 0
    held = [F.when(key, F.col(c)).otherwise(F.col(c) - F.lag(c).over(order)).alias(c) for c in cols]
    return out.select("idx", "frame", F.floor(F.col("_n") / every).alias("run"), key.alias("keyframe"), *held)


def restored(deltas: DataFrame, cols: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """The frames that keyframed() took, by running sums from each keyframe."""
    upto = Window.partitionBy("idx", "run").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    return deltas.select("idx", "frame", *(F.sum(c).over(upto).alias(c) for c in cols))


def displacement(frames: DataFrame) -> DataFrame:
    """Per frame: how far its nodes moved since their frame before, at most and on average; first frames count as no move."""
    order = Window.partitionBy("idx").orderBy("frame")
    far = F.sqrt(sum(((F.col(c) - F.lag(c).over(order)) ** 2 for c in "yz"), (F.col("x") - F.lag("x").over(order)) ** 2))
    moved = frames.select("frame", F.coalesce(far, F.lit(0.0)).alias("d"))
    return moved.groupBy("frame").agg(F.max("d").alias("most"), F.avg("d").alias("mean"))
