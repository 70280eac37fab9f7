"""Incremental pair generation over a stream of arriving images.

The stream is de-duplicated within a watermark; every micro-batch pairs its new
images among each other and with the known ones that share a point, and what it
adds to each pair is appended. Batches may be repeated after
a failure: the pairs of a batch are a pure function of the stores before it, and
a batch that was already written is recognised by its number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.operators.store import Store


def arrivals(stream: DataFrame, *, key: list[str], time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """The stream without repetitions inside the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windows(stream: DataFrame, *, time: str = "ts", length: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Arrivals of each type in tumbling (or sliding) windows."""
    window = F.window(time, length, slide) if slide else F.window(time, length)
    counted = stream.withWatermark(time, delay).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(stream: DataFrame, *, time: str = "ts", gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    """Sessions of each user: bursts without a longer gap."""
    counted = stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def increments(known: DataFrame, batch: DataFrame) -> DataFrame:
    """What a batch adds to the shared points of pairs: (image_id1 < image_id2, shared).

    ``known`` and ``batch``: (image_id, point_id). Rows of the batch that are known add
    nothing. The batch meets itself and the known rows apart, so that pairs are only
    counted, never told apart point by point.
    """
    known = known.select("image_id", "point_id").distinct()
    fresh = batch.select("image_id", "point_id").distinct().join(known, ["image_id", "point_id"], "left_anti")
    a = fresh.select("point_id", F.col("image_id").alias("a"))
    inside = a.join(fresh.select("point_id", F.col("image_id").alias("b")), "point_id").filter("a < b")
    across = a.join(known.select("point_id", F.col("image_id").alias("b")), "point_id").filter("a <> b")
    return inside.unionByName(across).groupBy(F.least("a", "b").alias("image_id1"), F.greatest("a", "b").alias("image_id2")).agg(F.count("*").alias("shared"))


def new_pairs(known: DataFrame, batch: DataFrame, done: DataFrame) -> DataFrame:
    """Pairs (image_id1 < image_id2, shared) of a batch that are not yet made.

    ``done``: (image_id1, image_id2).
    """
    return increments(known, batch).join(done.select("image_id1", "image_id2"), ["image_id1", "image_id2"], "left_anti")


class Ingest:
    """foreachBatch target that keeps observations and pairs as Parquet tables.

    The pairs' table holds what each batch added; ``pairs`` sums it up, so that a
    repeated image that brings further points raises the pairs it is in.
    """

    def __init__(self, spark, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def table(self, name: str, schema: str) -> DataFrame:
        store = Store(self.spark, self.path)
        if not store._fs.exists(store._path(f"{self.path}/{name}")):
            return self.spark.createDataFrame([], schema + ", batch bigint")
        return self.spark.read.schema(schema + ", batch bigint").parquet(f"{self.path}/{name}")

    def pairs(self) -> DataFrame:
        """All pairs so far: (image_id1, image_id2, shared)."""
        rows = self.table("pairs", "image_id1 bigint, image_id2 bigint, shared bigint")
        return rows.groupBy("image_id1", "image_id2").agg(F.sum("shared").alias("shared"))

    def __call__(self, batch: DataFrame, number: int) -> None:
        obs = self.table("obs", "image_id bigint, point_id bigint").filter(F.col("batch") != number).drop("batch")
        batch = batch.select("image_id", "point_id").persist()
        try:
            found = increments(obs, batch)
            # A repeated batch replaces what it wrote before.
            found.write.mode("overwrite").parquet(f"{self.path}/pairs/batch={number}")
            batch.write.mode("overwrite").parquet(f"{self.path}/obs/batch={number}")
        finally:
            batch.unpersist()


def run(stream: DataFrame, ingest: Ingest, checkpoint: str, **trigger):
    """Start the query; it takes all that is there unless told otherwise."""
    return stream.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
