"""Model analytics: counts, statistics, filters and rankings of observations.

Observations are rows (image_id, idx, point_id, ...); point_id is null for a
feature without a point.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions import geometry as g
from skein.functions.scalar import fraction_rank, percentile_of

from skein.session import cut

from .pairs import numbered


#: Images of a track that meet each other in one task.
TRACK = 1_024


def shared_points(obs: DataFrame, block: int = TRACK) -> DataFrame:
    """Images that see the same points: (image_id1 < image_id2, shared).

    Tracks of more than ``block`` images are dealt to blocks that meet two by two, so
    that a long one is many tasks' work.
    """
    rows = obs.select("point_id", "image_id").filter("point_id IS NOT NULL")
    sizes = rows.groupBy("point_id").agg(F.count("*").alias("n")).filter(F.col("n") > block)
    long = cut(sizes.select("point_id", F.ceil(F.col("n") / block).cast("long").alias("blocks")))
    if long.isEmpty():
        left, right = rows.withColumnRenamed("image_id", "image_id1"), rows.withColumnRenamed("image_id", "image_id2")
        return left.join(right, "point_id").filter("image_id1 < image_id2").groupBy("image_id1", "image_id2").agg(F.count("*").alias("shared"))
    few = F.broadcast(long) if long.count() <= 1_000_000 else long
    dealt = rows.join(few, "point_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long"))).withColumn("own", F.pmod(F.xxhash64("image_id"), "blocks"))
    left = dealt.select("point_id", F.col("image_id").alias("a"), F.col("own").alias("x"), F.explode(F.sequence("own", F.col("blocks") - 1)).alias("y"))
    right = dealt.select("point_id", F.col("image_id").alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), "own")).alias("x"), F.col("own").alias("y"))
    met = left.join(right, ["point_id", "x", "y"]).filter("(x < y AND a <> b) OR a < b")
    return met.groupBy(F.least("a", "b").alias("image_id1"), F.greatest("a", "b").alias("image_id2")).agg(F.count("*").alias("shared"))


def both_ways(pairs: DataFrame, *values: str) -> DataFrame:
    """Each pair from either side: (image_id, other, values...)."""
    there = pairs.select(F.col("image_id1").alias("image_id"), F.col("image_id2").alias("other"), *values)
    return there.unionByName(pairs.select(F.col("image_id2").alias("image_id"), F.col("image_id1").alias("other"), *values))


def top_overlap(pairs: DataFrame, k: int = 3, angle: Column | None = None) -> DataFrame:
    """The ``k`` images with most shared points of each image; ties to smaller ids."""
    rows = both_ways(pairs if angle is None else pairs.filter(angle), "shared")
    order = Window.partitionBy("image_id").orderBy(F.desc("shared"), "other")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def statistics(images: DataFrame, obs: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: images, registered images, points, observations, means (0 if none)."""
    triangulated = obs.filter("point_id IS NOT NULL")
    own = triangulated.agg(F.count("*").alias("observations"), F.countDistinct("point_id").alias("points"), F.countDistinct("image_id").alias("registered"))
    means = own.select(
        "registered",
        "points",
        "observations",
        F.coalesce(F.round(F.col("observations") / F.nullif("points", F.lit(0)), 6), F.lit(0.0)).alias("mean_track_length"),
        F.coalesce(F.round(F.col("observations") / F.nullif("registered", F.lit(0)), 6), F.lit(0.0)).alias("mean_per_image"),
    )
    out = means.crossJoin(images.agg(F.count("*").alias("images")))  # one row each
    if errors is not None:
        out = out.crossJoin(errors.filter("error >= 0").agg(F.coalesce(F.round(F.avg("error"), 6), F.lit(0.0)).alias("mean_error")))
    return out


def per_image_counts(images: DataFrame, obs: DataFrame) -> DataFrame:
    """Observations of each image, 0 where it has none."""
    counts = obs.groupBy("image_id").agg(F.count("*").alias("observations"))
    return images.select("image_id").join(counts, "image_id", "left").withColumn("observations", F.coalesce("observations", F.lit(0).cast("long")))


# Poses and errors -------------------------------------------------------------------


def pose(prefix: str = "") -> tuple[g.Quaternion, g.Vector]:
    """The pose columns of a scene row: a turn about z and a translation."""
    half = F.col(prefix + "half_yaw")
    return (F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half)), g.vector(prefix + "tx", prefix + "ty", prefix + "tz")


def with_error(seen: DataFrame, pose_of=pose) -> DataFrame:
    """Add ``depth`` and ``error2`` (squared reprojection error) to rows with pose, camera and point."""
    q, t = pose_of()
    p = g.to_camera(q, t, g.vector("px", "py", "pz"))
    seen = seen.withColumn("depth", p[2])
    pixel = g.project(F.lit(0), F.col("f"), F.col("cx"), F.col("cy"), F.lit(0.0), p)
    return seen.withColumn("error2", g.squared_reprojection_error(pixel, F.col("x"), F.col("y")))


def filter_depth(seen: DataFrame) -> DataFrame:
    """Observations of points in front of their camera."""
    return seen.filter("depth > 0")


def filter_reprojection(seen: DataFrame, most: float) -> DataFrame:
    """Drop observations that are off by more, then points with fewer than two left.

    Adds ``point_error``, the mean error of the point's remaining observations.
    """
    good = seen.filter(F.col("error2") <= most * most)
    own = Window.partitionBy("point_id")
    good = good.withColumn("left_over", F.count("*").over(own)).filter("left_over >= 2").drop("left_over")
    return good.withColumn("point_error", F.avg(F.sqrt("error2")).over(own))


def pair_angles(seen: DataFrame, pose_of=pose) -> DataFrame:
    """Angle at each point for each pair of its images."""
    q, t = pose_of()
    c = g.centre(q, t)
    at = seen.select("image_id", "point_id", "px", "py", "pz", *[x.alias(f"c{i}") for i, x in enumerate(c)])
    left = at.select("point_id", "px", "py", "pz", F.col("image_id").alias("image_id1"), *[F.col(f"c{i}").alias(f"l{i}") for i in range(3)])
    right = at.select("point_id", F.col("image_id").alias("image_id2"), *[F.col(f"c{i}").alias(f"r{i}") for i in range(3)])
    both = left.join(right, "point_id").filter("image_id1 < image_id2")
    angle = g.triangulation_angle(g.vector("l0", "l1", "l2"), g.vector("r0", "r1", "r2"), g.vector("px", "py", "pz"))
    return both.select("point_id", "image_id1", "image_id2", angle.alias("angle"))


def filter_angle(seen: DataFrame, least_degrees: float, pose_of=pose) -> DataFrame:
    """Points that some pair of images sees under at least this angle."""
    wide = pair_angles(seen, pose_of).groupBy("point_id").agg(F.max("angle").alias("angle")).filter(F.col("angle") >= F.radians(F.lit(least_degrees)))
    return seen.join(wide.select("point_id"), "point_id", "left_semi")


def filter_points(seen: DataFrame, most_error: float, least_degrees: float) -> DataFrame:
    """The reprojection filter, then the angle filter."""
    return filter_angle(filter_reprojection(seen, most_error), least_degrees)


def angle_percentile(angles: DataFrame, percent: float = 75.0) -> DataFrame:
    """Angle of each image pair at a nearest rank."""
    return angles.groupBy("image_id1", "image_id2").agg(percentile_of(F.col("angle"), percent).alias("angle"))


def depth_ranges(seen: DataFrame, low: float = 0.01, high: float = 0.99, stretch: float = 0.25) -> DataFrame:
    """Depth range of each image from its positive depths; -1 if it has none."""
    depths = seen.groupBy("image_id").agg(F.collect_list(F.when(F.col("depth") > 0, F.col("depth"))).alias("d"))  # an image's points
    pick = lambda p, k: F.when(F.size("d") == 0, F.lit(-1.0)).otherwise(fraction_rank(F.col("d"), p) * k)
    return depths.select("image_id", pick(low, 1 - stretch).alias("near"), pick(high, 1 + stretch).alias("far"))


def visibility(obs: DataFrame, width: float, height: float, levels: int = 6) -> DataFrame:
    """Score of each image: occupied cells of every pyramid level times its cells."""
    top = 1 << levels
    cell = lambda x, size: F.least(F.greatest(F.floor(F.col(x) * top / size), F.lit(0)), F.lit(top - 1)).cast("int")
    rows = obs.select("image_id", cell("x", width).alias("cx"), cell("y", height).alias("cy")).distinct()
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    shift = F.lit(levels) - F.col("level")
    rows = rows.select("image_id", "level", F.call_function("shiftright", "cx", shift).alias("cx"), F.call_function("shiftright", "cy", shift).alias("cy"))
    counts = rows.groupBy("image_id", "level").agg(F.countDistinct("cx", "cy").alias("n"))
    return counts.groupBy("image_id").agg(F.sum(F.col("n") * F.pow(F.lit(4.0), F.col("level"))).cast("long").alias("score"))


# Tracks -------------------------------------------------------------------------------


def one_per_image(rows: DataFrame, track: str = "point_id", order: list[str] | None = None) -> DataFrame:
    """The first element of each image in each track."""
    own = Window.partitionBy(track, "image_id").orderBy(*(order or ["idx"]))
    return rows.withColumn("_r", F.row_number().over(own)).filter("_r = 1").drop("_r")


def track_lengths(obs: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """Tracks by length, within a range."""
    lengths = obs.groupBy("point_id").agg(F.count("*").alias("length")).filter(F.col("length") >= least)
    return lengths if most is None else lengths.filter(F.col("length") <= most)


def short_tracks_dropped(obs: DataFrame, least: int) -> DataFrame:
    return obs.join(track_lengths(obs, least).select("point_id"), "point_id", "left_semi")


def track_statistics(seen: DataFrame, most: int = 10) -> DataFrame:
    """Length up to ``most`` and mean squared error of each track."""
    return seen.groupBy("point_id").agg(F.least(F.count("*"), F.lit(most)).alias("length"), F.avg("error2").alias("mean_error2"))


def grid_best(seen: DataFrame, tracks: DataFrame, cell: float = 100.0, *, prefer_long: bool = False) -> DataFrame:
    """The best track of each image and grid cell: by length, then error, then id.

    By default short tracks come first.
    """
    place = [F.col(c).try_cast("double") / cell for c in ("x", "y")]
    rows = seen.select("image_id", "point_id", *[p.cast("int").alias(c) for p, c in zip(place, ("cx", "cy"))]).join(tracks, "point_id")
    length = F.desc("length") if prefer_long else F.asc("length")
    order = Window.partitionBy("image_id", "cx", "cy").orderBy(length, F.round("mean_error2", 6), "point_id")
    return rows.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select("image_id", "cx", "cy", "point_id")


def selected_tracks(seen: DataFrame, tracks: DataFrame, per_image: int, cell: float = 100.0) -> DataFrame:
    """Tracks for a bundle problem: the grid's best, then each image's next best.

    Images fill up to ``per_image`` tracks from their own ranking; an image's
    choice does not wait for the others', so that the step is one window.
    """
    best = grid_best(seen, tracks, cell).select("image_id", "point_id").withColumn("picked", F.lit(0))
    own = seen.select("image_id", "point_id").join(tracks, "point_id").join(best, ["image_id", "point_id"], "left")
    order = Window.partitionBy("image_id").orderBy(F.asc_nulls_last("picked"), "length", F.round("mean_error2", 6), "point_id")
    ranked = own.withColumn("_r", F.row_number().over(order))
    return ranked.filter((F.col("_r") <= per_image) | F.col("picked").isNotNull()).select("point_id").distinct()


def selected_in_turn(seen: DataFrame, tracks: DataFrame, per_image: int, group: str, cell: float = 100.0) -> DataFrame:
    """As ``selected_tracks``, but images take their turns by id within a ``group`` (one
    bundle problem, so of bounded size) and count what others have picked before.

    An image that sees ``per_image`` picked tracks, or only picked ones, adds none.
    Returns the distinct (group, point_id).
    """
    best = grid_best(seen, tracks, cell).select("image_id", "point_id", F.lit(True).alias("picked"))
    rows = seen.select(group, "image_id", "point_id").join(tracks, "point_id").join(best, ["image_id", "point_id"], "left")
    rows = rows.select(F.col(group).cast("long").alias("label"), "image_id", "point_id", F.col("length").cast("long").alias("length"), F.round("mean_error2", 6).alias("error"), F.coalesce("picked", F.lit(False)).alias("picked"))

    def run(pdf):
        chosen = set(pdf.loc[pdf["picked"], "point_id"])
        for _, own in pdf.sort_values(["image_id", "length", "error", "point_id"]).groupby("image_id", sort=True):
            ids = list(dict.fromkeys(own["point_id"]))
            left = [i for i in ids if i not in chosen]
            chosen.update(left[: max(0, min(per_image, len(ids)) - (len(ids) - len(left)))])
        return pdf[pdf["point_id"].isin(chosen)][["label", "point_id"]].drop_duplicates()

    return rows.groupBy("label").applyInPandas(run, "label bigint, point_id bigint").withColumnRenamed("label", group)


# Growing tracks -----------------------------------------------------------------------


def completed(pixels: DataFrame, obs: DataFrame, corr: DataFrame, points: DataFrame, most: float, rounds: int = 1, pose_of=pose) -> DataFrame:
    """Features without a point that continue a track: (image_id, idx, point_id).

    ``pixels`` holds each feature's pose, camera and pixel, ``obs`` the features that have
    points. A feature takes the point of a corresponding one that it sees with the smallest
    error, if that is at most ``most``. ``rounds`` steps go on from what was added.
    """
    known, front, out = obs.select("image_id", "idx"), obs.select("image_id", "idx", "point_id"), None
    for _ in range(rounds):
        there = front.select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"), "point_id")
        candidates = corr.join(known, ["image_id", "idx"], "left_anti").join(there, ["other", "other_idx"]).select("image_id", "idx", "point_id").distinct()
        rows = with_error(candidates.join(pixels, ["image_id", "idx"]).join(points, "point_id"), pose_of).filter(F.col("error2") <= most * most)
        front = cut(rows.groupBy("image_id", "idx").agg(F.min_by("point_id", F.struct(F.round(F.sqrt("error2"), 4), "point_id")).alias("point_id")))
        known = known.unionByName(front.select("image_id", "idx"))
        out = front if out is None else out.unionByName(front)
    return out


def mergeable(pixels: DataFrame, obs: DataFrame, corr: DataFrame, points: DataFrame, most: float, pose_of=pose) -> DataFrame:
    """Pairs of points that correspondences join and that one point can replace.

    The point between them, weighted by track length, must be seen with at most ``most``
    error by every observation of both. A point takes part in one pair: two points merge if
    each is the other's smallest partner. Returns (id1, id2, px, py, pz), id1 < id2.
    """
    here = obs.select("image_id", "idx", F.col("point_id").alias("id1"))
    there = obs.select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"), F.col("point_id").alias("id2"))
    pairs = corr.join(here, ["image_id", "idx"]).join(there, ["other", "other_idx"]).filter("id1 < id2").select("id1", "id2").distinct()
    sized = obs.groupBy("point_id").agg(F.count("*").alias("n")).join(points.select("point_id", "px", "py", "pz"), "point_id")
    for k, side in (("id1", "a_"), ("id2", "b_")):
        pairs = pairs.join(sized.select(F.col("point_id").alias(k), *[F.col(c).alias(side + c) for c in ("n", "px", "py", "pz")]), k)
    between = cut(pairs.select("id1", "id2", *merge_two("a_", "b_", ["px", "py", "pz"], "a_n", "b_n")))
    rows = between.withColumn("point_id", F.explode(F.array("id1", "id2"))).join(obs.select("image_id", "idx", "point_id"), "point_id").join(pixels, ["image_id", "idx"])
    good = with_error(rows, pose_of).groupBy("id1", "id2").agg(F.max("error2").alias("worst")).filter(F.col("worst") <= most * most).select("id1", "id2")
    good = cut(good)
    partner = good.unionByName(good.select(F.col("id2").alias("id1"), F.col("id1").alias("id2"))).groupBy(F.col("id1").alias("id")).agg(F.min("id2").alias("partner"))
    both = partner.join(partner.select(F.col("id").alias("partner"), F.col("partner").alias("back")), "partner").filter("id = back AND id < partner")
    return between.join(both.select(F.col("id").alias("id1"), F.col("partner").alias("id2")), ["id1", "id2"])


def merge_two(a: str, b: str, columns: list[str], wa: str, wb: str) -> list[Column]:
    """Weighted means of two points' columns (by track length)."""
    total = F.col(wa) + F.col(wb)
    return [((F.col(f"{a}{c}") * F.col(wa) + F.col(f"{b}{c}") * F.col(wb)) / total).alias(c) for c in columns]


def mean_colours(obs: DataFrame, colours: DataFrame) -> DataFrame:
    """Mean colour of each point over its images, cut to integers; black if none."""
    rows = obs.select("image_id", "point_id").join(colours, "image_id", "left")
    return rows.groupBy("point_id").agg(*[F.coalesce(F.floor(F.avg(c)), F.lit(0)).cast("int").alias(c) for c in "rgb"])


def bounding_box(points: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Robust box and trimmed mean of each axis, ranked apart.

    One row an axis. Ranks come from a window over one axis of single precision
    values, pre-aggregated to distinct values with their counts.
    """
    axes = reduce(DataFrame.unionByName, [points.select(F.lit(a).alias("axis"), F.col(c).cast("float").alias("v")) for a, c in (("x", "px"), ("y", "py"), ("z", "pz"))])
    values = axes.groupBy("axis", "v").agg(F.count("*").alias("n"))
    order = Window.partitionBy("axis").orderBy("v")
    everything = Window.partitionBy("axis")
    values = values.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(everything))
    p0 = F.when(F.col("all") > 3, F.floor(low * (F.col("all") - 1))).otherwise(F.lit(0))
    p1 = F.when(F.col("all") > 3, F.floor(high * (F.col("all") - 1))).otherwise(F.col("all") - 1)
    values = values.withColumn("p0", p0).withColumn("p1", p1)
    inside = F.greatest(F.lit(0), F.least(F.col("upto"), F.col("p1") + 1) - F.greatest(F.col("upto") - F.col("n"), F.col("p0")))
    low_at = (F.col("upto") > F.col("p0")) & (F.col("upto") - F.col("n") <= F.col("p0"))
    high_at = (F.col("upto") > F.col("p1")) & (F.col("upto") - F.col("n") <= F.col("p1"))
    return values.groupBy("axis").agg(
        F.max(F.when(low_at, F.col("v"))).cast("double").alias("low"), F.max(F.when(high_at, F.col("v"))).cast("double").alias("high"),
        (F.sum(F.col("v").cast("double") * inside) / F.sum(inside)).alias("mean"),
    )


def normalized(points: DataFrame, extent: float = 10.0, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """Points moved to the trimmed mean and scaled so that the box's diagonal is ``extent``."""
    box = bounding_box(points, low, high)
    flat = box.agg(*[F.max(F.when(F.col("axis") == a, F.col("mean"))).alias(f"m{a}") for a in "xyz"], F.sqrt(F.sum(F.pow(F.col("high") - F.col("low"), F.lit(2)))).alias("old"))
    scale = F.when(F.col("old") < 2.220446049250313e-16, F.lit(1.0)).otherwise(F.lit(extent) / F.col("old"))
    rows = points.crossJoin(F.broadcast(flat))  # one row
    return rows.select("point_id", *[((F.col(f"p{a}") - F.col(f"m{a}")) * scale).alias(f"p{a}") for a in "xyz"])


# Images and cameras ------------------------------------------------------------------------


def bogus(camera_cols: dict[str, str] | None = None, *, min_focal: float = 0.1, max_focal: float = 10.0, max_extra: float = 1.0) -> Column:
    """Whether intrinsics are implausible."""
    c = {k: k for k in ("f", "cx", "cy", "width", "height", "k1")} | (camera_cols or {})
    f, cx, cy, w, h, k1 = (F.col(c[k]) for k in ("f", "cx", "cy", "width", "height", "k1"))
    ratio = f / F.greatest(w, h)
    return (cx < 0) | (cx > w) | (cy < 0) | (cy > h) | (ratio < min_focal) | (ratio > max_focal) | (F.abs(k1) > max_extra)


def images_to_drop(images: DataFrame, cameras: DataFrame, obs: DataFrame, **limits) -> DataFrame:
    """Images without points or with a bogus camera."""
    counts = obs.filter("point_id IS NOT NULL").groupBy("image_id").agg(F.count("*").alias("n"))
    rows = images.select("image_id", "camera_id").join(cameras.select("camera_id", "f", "cx", "cy", "width", "height", "k1"), "camera_id").join(counts, "image_id", "left")
    return rows.filter(F.col("n").isNull() | bogus(**limits)).select("image_id")


def next_images(candidates: DataFrame, score: str) -> DataFrame:
    """Rank of images to register: untried first, then by score, then by id."""
    rows = candidates.withColumn("_score", -F.col(score))
    return numbered(rows, ["trials", "_score", "image_id"], "rank").withColumn("rank", (F.col("rank") + 1).cast("int")).drop("_score")


def initial_pairs(cameras: DataFrame, images: DataFrame, correspondences: DataFrame) -> DataFrame:
    """Pairs to begin with: prior focal lengths first, then most correspondences."""
    prior = images.join(cameras.select("camera_id", "prior_focal"), "camera_id").select("image_id", F.col("prior_focal").cast("int").alias("p"))
    rows = correspondences.join(prior.select(F.col("image_id").alias("image_id1"), F.col("p").alias("p1")), "image_id1").join(prior.select(F.col("image_id").alias("image_id2"), F.col("p").alias("p2")), "image_id2")
    order = Window.partitionBy("image_id1").orderBy(F.desc("p2"), F.desc("shared"), "image_id2")
    return rows.withColumn("rank", F.row_number().over(order)).select("image_id1", "image_id2", "shared", "p1", "p2", "rank")


# Correspondences -----------------------------------------------------------------------------


def correspondences(matches: DataFrame) -> DataFrame:
    """Matches from either side: (image_id, idx, other, other_idx).

    Of repeated matches of a feature with the same image the first counts, on both
    sides, in order of (idx1, idx2).
    """
    first1 = Window.partitionBy("image_id1", "idx1", "image_id2").orderBy("idx2")
    first2 = Window.partitionBy("image_id2", "idx2", "image_id1").orderBy("idx1")
    good = matches.withColumn("_a", F.row_number().over(first1)).filter("_a = 1").withColumn("_b", F.row_number().over(first2)).filter("_b = 1")
    there = good.select(F.col("image_id1").alias("image_id"), F.col("idx1").alias("idx"), F.col("image_id2").alias("other"), F.col("idx2").alias("other_idx"))
    back = good.select(F.col("image_id2").alias("image_id"), F.col("idx2").alias("idx"), F.col("image_id1").alias("other"), F.col("idx1").alias("other_idx"))
    return there.unionByName(back)


def correspondence_counts(corr: DataFrame) -> DataFrame:
    """Per image: matched features and correspondences."""
    return corr.groupBy("image_id").agg(F.countDistinct("idx").alias("features"), F.count("*").alias("correspondences"))


def pair_counts(corr: DataFrame) -> DataFrame:
    return corr.filter("image_id < other").groupBy(F.col("image_id").alias("image_id1"), F.col("other").alias("image_id2")).agg(F.count("*").alias("correspondences"))


def two_view_observations(corr: DataFrame) -> DataFrame:
    """Features with one neighbour that has only them."""
    single = corr.groupBy("image_id", "idx").agg(F.count("*").alias("n"), F.min("other").alias("other"), F.min("other_idx").alias("other_idx")).filter("n = 1")
    back = single.select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"))
    return single.join(back, ["other", "other_idx"], "left_semi").select("image_id", "idx")


def reachable(corr: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Features up to ``depth`` matches away from each start (image_id, idx)."""
    front = start.select(F.col("image_id").alias("s"), F.col("idx").alias("sidx"), "image_id", "idx")
    seen = front.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        step = front.join(corr, ["image_id", "idx"]).select("s", "sidx", F.col("other").alias("image_id"), F.col("other_idx").alias("idx")).distinct()
        front = step.join(seen, ["s", "sidx", "image_id", "idx"], "left_anti")
        seen = seen.unionByName(front.withColumn("depth", F.lit(k)))
    return seen.filter("depth > 0")


def visible_points(corr: DataFrame, obs: DataFrame) -> DataFrame:
    """Per image: features with a correspondence that has a point."""
    other = obs.filter("point_id IS NOT NULL").select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"))
    return corr.join(other, ["other", "other_idx"], "left_semi").groupBy("image_id").agg(F.countDistinct("idx").alias("visible"))


def registration_candidates(corr: DataFrame, obs: DataFrame, image: int) -> DataFrame:
    """2D-3D correspondences of an image: distinct (idx, point_id)."""
    own = corr.filter(F.col("image_id") == image)
    other = obs.filter("point_id IS NOT NULL").select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"), "point_id")
    return own.join(other, ["other", "other_idx"]).select("idx", "point_id").distinct()


def bundle_residuals(obs: DataFrame, images: DataFrame) -> DataFrame:
    """Residuals of a bundle problem over some images: twice the observations of
    these images and of their points elsewhere."""
    own = obs.join(images.select("image_id"), "image_id", "left_semi")
    elsewhere = obs.join(images.select("image_id"), "image_id", "left_anti").join(own.select("point_id").distinct(), "point_id", "left_semi")
    return own.select("point_id").unionByName(elsewhere.select("point_id")).agg((2 * F.count("*")).alias("residuals"))


#: Steps by which the local bundle's gates are relaxed: what the angle is divided by,
#: and the share of the image's points that must be shared (fixed values).
BUNDLE_STEPS = ((1.0, 0.6), (1.5, 0.6), (2.0, 0.5), (2.5, 0.4), (3.0, 0.3), (4.0, 0.2), (5.0, 0.1), (6.0, 0.1))


def local_bundle(pairs: DataFrame, counts: DataFrame, size: int = 6, min_degrees: float = 6.0) -> DataFrame:
    """The images to refine with each image: (image_id, other, shared, step, rank).

    ``pairs``: (image_id1, image_id2, shared, angle in radians); ``counts``: (image_id,
    points). Neighbours that pass the first step's gates of angle and overlap come
    first, then those of the next step, and so on; those that pass none fill up. In a
    step most shared points come first. An image has ``size - 1`` neighbours at most.
    """
    rows = both_ways(pairs, "shared", "angle").join(counts.select("image_id", "points"), "image_id")
    step = F.lit(len(BUNDLE_STEPS))
    for k in range(len(BUNDLE_STEPS) - 1, -1, -1):
        below, share = BUNDLE_STEPS[k]
        step = F.when((F.col("shared") >= share * F.col("points")) & (F.col("angle") >= F.radians(F.lit(min_degrees)) / below), F.lit(k)).otherwise(step)
    order = Window.partitionBy("image_id").orderBy("step", F.desc("shared"), "other")
    return rows.withColumn("step", step).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") < size).select("image_id", "other", "shared", "step", "rank")


def best_candidate(candidates: DataFrame, most: float) -> DataFrame:
    """For each feature the point of least angular error, if that is at most ``most``:
    (image_id, idx, point_id, error); ties to the smaller point."""
    best = candidates.groupBy("image_id", "idx").agg(F.min(F.struct("error", "point_id")).alias("m"))
    return best.select("image_id", "idx", "m.point_id", "m.error").filter(F.col("error") <= most)


def correspondences_between(corr: DataFrame, a: int, b: int) -> DataFrame:
    """(idx, other_idx) of the correspondences from one image to another."""
    return corr.filter((F.col("image_id") == a) & (F.col("other") == b)).select("idx", "other_idx")


def filter_in(seen: DataFrame, ids: DataFrame, column: str, most_error: float, least_degrees: float) -> DataFrame:
    """``filter_points`` for some points only: those whose ``column`` (point_id, or
    image_id for the points of some images) is listed; the others stay as they are."""
    chosen = seen.join(ids.select(column).distinct(), column, "left_semi").select("point_id").distinct()
    inside, outside = seen.join(chosen, "point_id", "left_semi"), seen.join(chosen, "point_id", "left_anti")
    return filter_points(inside, most_error, least_degrees).select(*seen.columns).unionByName(outside.select(*seen.columns))


def under_reconstructed(pair_stats: DataFrame, registered: DataFrame, least: float = 0.2) -> DataFrame:
    """Pairs of registered images of whose correspondences too few have points."""
    ids = registered.select("image_id")
    rows = pair_stats.filter(F.col("triangulated") / F.col("total") < least)
    return rows.join(ids, rows["image_id1"] == ids["image_id"], "left_semi").join(ids, rows["image_id2"] == ids["image_id"], "left_semi")


def pair_statistics(corr: DataFrame, obs: DataFrame) -> DataFrame:
    """Per pair: correspondences, and those whose both features share a point."""
    pts = obs.select("image_id", "idx", "point_id")
    rows = corr.filter("image_id < other").join(pts.withColumnRenamed("point_id", "p1"), ["image_id", "idx"], "left")
    rows = rows.join(pts.select(F.col("image_id").alias("other"), F.col("idx").alias("other_idx"), F.col("point_id").alias("p2")), ["other", "other_idx"], "left")
    return rows.groupBy(F.col("image_id").alias("image_id1"), F.col("other").alias("image_id2")).agg(F.count("*").alias("total"), F.sum((F.col("p1") == F.col("p2")).cast("long")).alias("triangulated"))


def visibility_lists(pairs: DataFrame) -> DataFrame:
    """Sorted neighbours of each image."""
    return both_ways(pairs).groupBy("image_id").agg(F.sort_array(F.collect_set("other")).alias("neighbours"))  # an image's degree
