"""Multi-view operators: source views, voting, rigs, fused points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions import geometry as g

from .model import both_ways


def source_images(pairs: DataFrame, references: DataFrame, *, most: int = 20, angle: Column | None = None) -> DataFrame:
    """The sources of each reference image: most shared points first, within the
    configured set, above the angle gate. References without sources are absent."""
    rows = both_ways(pairs if angle is None else pairs.filter(angle), "shared")
    ids = references.select("image_id")
    rows = rows.join(ids, "image_id", "left_semi").join(ids.withColumnRenamed("image_id", "other"), "other", "left_semi")
    order = Window.partitionBy("image_id").orderBy(F.desc("shared"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def overlap_images(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """Images across each cluster's boundary, by the heaviest edges."""
    left, right = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    lost = edges.join(left, "src").join(right, "dst").filter("ls <> ld")
    offers = lost.select(F.col("ls").alias("label"), F.col("dst").alias("id"), "weight").unionByName(lost.select(F.col("ld").alias("label"), F.col("src").alias("id"), "weight"))
    best = offers.groupBy("label", "id").agg(F.max("weight").alias("weight"))
    order = Window.partitionBy("label").orderBy(F.desc("weight"), "id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def votes(matches: DataFrame, group: list[str], *, max_shift: float = 4096.0, shift_bins: int = 64, scale_bins: int = 32, angle_bins: int = 8, levels: int = 6, least: int = 1) -> DataFrame:
    """Scores of transformation bins: votes of each bin, and of its parents at half
    weight a level.

    ``matches``: group columns and tx, ty, scale, angle (radians). Levels are
    aggregated from the finest counts, so matches are shuffled once.
    """
    log_scale, most = F.log2("scale"), float(np.log2(10.0))
    rows = matches.filter((F.abs("tx") <= max_shift) & (F.abs("ty") <= max_shift)).withColumn("_s", log_scale).filter(F.abs("_s") <= most)
    bin_ = lambda x, n: F.least((x * n).cast("int"), F.lit(n - 1))
    rows = rows.select(
        *group,
        bin_((F.col("tx") + max_shift) / (2 * max_shift), shift_bins).alias("x"), bin_((F.col("ty") + max_shift) / (2 * max_shift), shift_bins).alias("y"),
        bin_((F.col("_s") + most) / (2 * most), scale_bins).alias("s"), bin_((F.col("angle") + float(np.pi)) / float(2 * np.pi), angle_bins).alias("a"),
    )
    fine = rows.groupBy(*group, "x", "y", "s", "a").agg(F.count("*").alias("n"))
    up = fine.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels - 1))))
    parent = [F.call_function("shiftright", c, F.col("level")).alias("p" + c) for c in "xysa"]
    coarse = up.select(*group, "level", "n", *parent).groupBy(*group, "level", "px", "py", "ps", "pa").agg(F.sum("n").alias("m"))
    kept = fine.filter(F.col("n") >= least).withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels - 1)))).select("*", *parent)
    scored = kept.join(coarse, [*group, "level", "px", "py", "ps", "pa"]).groupBy(*group, "x", "y", "s", "a", "n").agg(F.sum(F.col("m") * F.pow(F.lit(0.5), F.col("level"))).alias("extra"))
    return scored.select(*group, "x", "y", "s", "a", F.col("n").alias("votes"), (F.col("n") + F.col("extra")).alias("score"))


def top_votes(scored: DataFrame, group: list[str], most: int) -> DataFrame:
    """The ``most`` best bins of each group, by score, then votes, then place."""
    order = Window.partitionBy(*group).orderBy(F.desc(F.round("score", 6)), F.desc("votes"), "x", "y", "s", "a")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def one_to_one(candidates: DataFrame, group: list[str]) -> DataFrame:
    """Matches (a, b, score) without repeated features, fewest options first.

    A group is one image pair. The feature with the fewest remaining options (ties:
    a before b, then the smaller number) takes its best partner that is free.
    """
    schema = ", ".join(f"{n} bigint" for n in group) + ", a bigint, b bigint, score double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left = {(int(r.a), int(r.b)): float(r.score) for r in pdf.itertuples()}
        out = []
        while left:
            options: dict = {}
            for a, b in left:
                options.setdefault((0, a), []).append((a, b))
                options.setdefault((1, b), []).append((a, b))
            feature = min(options, key=lambda k: (len(options[k]), k))
            a, b = max(options[feature], key=lambda e: (left[e], -e[0], -e[1]))
            out.append((a, b, left[a, b]))
            left = {e: s for e, s in left.items() if e[0] != a and e[1] != b}
        made = pd.DataFrame(out, columns=["a", "b", "score"])
        for n in reversed(group):
            made.insert(0, n, pdf[n].iloc[0])
        return made

    return candidates.groupBy(*group).applyInPandas(run, schema)


def rig_scale(rig: DataFrame, images: DataFrame, least: float = 1e-6) -> DataFrame:
    """Mean ratio of relative to absolute distances of a rig's cameras.

    ``rig``: (camera_id, x, y, z), the relative centres; ``images``: (snapshot,
    camera_id, x, y, z), the absolute ones. One row; NaN without a distance.
    """
    rows = images.join(rig.select("camera_id", *[F.col(c).alias("r" + c) for c in "xyz"]), "camera_id")
    a = rows.select("snapshot", *[F.col(c).alias("a_" + c) for c in ("camera_id", "x", "y", "z", "rx", "ry", "rz")])
    b = rows.select("snapshot", *[F.col(c).alias("b_" + c) for c in ("camera_id", "x", "y", "z", "rx", "ry", "rz")])
    both = a.join(b, "snapshot").filter("a_camera_id < b_camera_id")
    d = lambda p: g.norm(tuple(F.col(f"a_{p}{c}") - F.col(f"b_{p}{c}") for c in "xyz"))
    both = both.select(d("r").alias("relative"), d("").alias("absolute")).filter((F.col("relative") > least) & (F.col("absolute") > least))
    return both.agg(F.coalesce(F.avg(F.col("relative") / F.col("absolute")), F.lit(float("nan"))).alias("scale"))


def rig_poses(images: DataFrame) -> DataFrame:
    """Mean relative pose of each camera to the snapshot's reference camera.

    ``images``: (snapshot, camera_id, reference boolean, q array, t array).
    """
    ref = images.filter("reference").select("snapshot", F.col("q").alias("rq"), F.col("t").alias("rt"))
    rows = images.join(ref, "snapshot")
    quaternion, vector = lambda c: tuple(F.col(c)[i] for i in range(4)), lambda c: tuple(F.col(c)[i] for i in range(3))
    q, t = g.relative_pose(quaternion("rq"), vector("rt"), quaternion("q"), vector("t"))
    rows = rows.select("camera_id", *[c.alias(f"q{i}") for i, c in enumerate(q)], *[c.alias(f"t{i}") for i, c in enumerate(t)])
    # The weighted mean rotation is the largest eigenvector of the sum of q q'.
    products = [F.sum(F.col(f"q{i}") * F.col(f"q{j}")).alias(f"m{i}{j}") for i in range(4) for j in range(4)]
    sums = rows.groupBy("camera_id").agg(*products, *[F.avg(f"t{i}").alias(f"t{i}") for i in range(3)])

    def run(frames):
        for frame in frames:
            m = frame[[f"m{i}{j}" for i in range(4) for j in range(4)]].to_numpy().reshape(-1, 4, 4)
            q = np.linalg.eigh(m)[1][:, :, -1]
            q = q * np.where(q[:, :1] < 0, -1, 1)
            yield pd.DataFrame({"camera_id": frame["camera_id"], "q": list(q), "t": list(frame[["t0", "t1", "t2"]].to_numpy())})

    return sums.mapInPandas(run, "camera_id bigint, q array<double>, t array<double>")


def fused_points(pixels: DataFrame, least: int = 5) -> DataFrame:
    """Median position, normal and colour of each pixel cluster of enough pixels."""
    values = ["x", "y", "z", "nx", "ny", "nz", "r", "g", "b"]
    return pixels.groupBy("cluster").agg(F.count("*").alias("n"), *[F.median(c).alias(c) for c in values]).filter(F.col("n") >= least)


def consistent_pixels(pixels: DataFrame, neighbours: DataFrame, *, depth: float = 0.01, shift: float = 2.0, normal: float = 10.0) -> DataFrame:
    """Pixel pairs that agree in depth, place and normal, for fusion.

    ``neighbours`` joins pixels (a, b) with the expected depth and place of b:
    (a, b, depth_b, dx, dy); ``pixels``: (id, depth, nx, ny, nz).
    """
    a = pixels.select(F.col("id").alias("a"), *[F.col(c).alias("a" + c) for c in ("nx", "ny", "nz")])
    b = pixels.select(F.col("id").alias("b"), F.col("depth").alias("found"), *[F.col(c).alias("b" + c) for c in ("nx", "ny", "nz")])
    rows = neighbours.join(a, "a").join(b, "b")
    cosine = g.dot(g.vector("anx", "any", "anz"), g.vector("bnx", "bny", "bnz"))
    good = (F.abs(F.col("depth_b") - F.col("found")) / F.col("depth_b") <= depth) & (F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) <= shift) & (cosine >= float(np.cos(np.radians(normal))))
    return rows.filter(good).select("a", "b")
