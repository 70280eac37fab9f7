"""Edits of a model's observation table (image_id, idx, point_id) and its points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def delete_observations(obs: DataFrame, gone: DataFrame) -> DataFrame:
    """Take observations (image_id, idx) out of their tracks.

    A point of which two or fewer elements would be left to delete from goes as a
    whole: a track that loses elements down to one element is dropped.
    """
    marked = obs.join(gone.select("image_id", "idx", F.lit(True).alias("_gone")), ["image_id", "idx"], "left")
    own = Window.partitionBy("point_id")
    left = F.sum(F.when(F.col("_gone").isNull(), 1).otherwise(0)).over(own)
    dead = F.col("_gone").isNotNull() | ((left < 2) & F.max(F.col("_gone")).over(own).isNotNull())
    return marked.withColumn("point_id", F.when(F.col("point_id").isNotNull() & ~dead, F.col("point_id"))).drop("_gone")


def delete_points(obs: DataFrame, points: DataFrame) -> DataFrame:
    """Observations whose point is listed lose it."""
    marked = obs.join(points.select("point_id", F.lit(True).alias("_gone")).distinct(), "point_id", "left")
    return marked.withColumn("point_id", F.when(F.col("_gone").isNull(), F.col("point_id"))).drop("_gone")


def add_points(obs: DataFrame, tracks: DataFrame) -> DataFrame:
    """Give observations that have no point one of new tracks (image_id, idx, new_id)."""
    marked = obs.join(tracks.select("image_id", "idx", "new_id"), ["image_id", "idx"], "left")
    return marked.withColumn("point_id", F.coalesce("point_id", "new_id")).drop("new_id")


def merge_points(obs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Points (id1, id2) become one with the id ``id1``."""
    ids = pairs.select(F.col("id2").alias("point_id"), F.col("id1").alias("_to"))
    return obs.join(ids, "point_id", "left").withColumn("point_id", F.coalesce("_to", "point_id")).drop("_to")


def deregister(obs: DataFrame, images: DataFrame) -> DataFrame:
    """Take whole images out of the model."""
    return delete_observations(obs, obs.join(images.select("image_id"), "image_id", "left_semi").filter("point_id IS NOT NULL"))


def split_by_mask(matches: Column, mask: Column) -> tuple[Column, Column]:
    """Inlier and outlier matches of a list by a list of booleans."""
    both = F.arrays_zip(matches.alias("m"), mask.alias("k"))
    pick = lambda want: F.transform(F.filter(both, lambda x: x["k"] == want), lambda x: x["m"])
    return pick(True), pick(False)
