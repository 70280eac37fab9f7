"""Tracks: features that verified matches connect."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from skein.session import cut

from .components import connected_components
from .model import one_per_image

#: Features of an image are numbered below this.
_FEATURES = 1 << 32


def build(geometries: DataFrame, least: int = 2) -> DataFrame:
    """(track, image_id, idx) from pairs (image_id1, image_id2, inliers).

    A track is a connected group of features; of several features of one image the first
    stays, and tracks of fewer than ``least`` images are left out. A track is named by its
    smallest feature.
    """
    key = lambda image, idx: (F.col(image) * F.lit(_FEATURES) + F.col(idx)).cast("long")
    matches = geometries.select("image_id1", "image_id2", F.explode("inliers").alias("m")).select("image_id1", "image_id2", "m.idx1", "m.idx2")
    labels = connected_components(matches.select(key("image_id1", "idx1").alias("a"), key("image_id2", "idx2").alias("b")))
    rows = labels.select(F.col("component").alias("track"), F.floor(F.col("id") / _FEATURES).alias("image_id"), F.pmod("id", F.lit(_FEATURES)).alias("idx"))
    kept = cut(one_per_image(rows, "track"))
    long = kept.groupBy("track").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return kept.join(long, "track", "left_semi").select("track", "image_id", "idx")
