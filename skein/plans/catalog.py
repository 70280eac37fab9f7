"""Registered queries of the engine's own operators, each with its DuckDB form.

``QUERIES[name](spark, sf_dir)`` runs an operator over the scene views;
``ORACLES[name]`` is the same result in SQL, written independently.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from skein.functions import geometry as g, scalar as s
from skein.operators import edits, graph, model, pairs, partition, retrieval, store, views
from skein.session import cut, cut_packed
from skein.views import frame

from .registry import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES", "flagship"]

# Store: scans, look-ups, counts -----------------------------------------------------


@query("SELECT (SELECT count(*) FROM {images}) AS images, (SELECT count(*) FROM {cameras}) AS cameras, (SELECT count(*) FROM {obs}) AS observations, (SELECT max(n) FROM (SELECT count(*) AS n FROM {obs} GROUP BY image_id)) AS most")
def table_counts(v):
    obs = v("obs").groupBy("image_id").agg(F.count("*").alias("n")).agg(F.sum("n").alias("observations"), F.max("n").alias("most"))
    return v("images").agg(F.count("*").alias("images")).crossJoin(v("cameras").agg(F.count("*").alias("cameras"))).crossJoin(obs)


@query("SELECT i.image_id, CAST(coalesce(n, 0) AS BIGINT) AS observations FROM {images} i LEFT JOIN (SELECT image_id, count(*) AS n FROM {obs} GROUP BY image_id) o ON i.image_id = o.image_id")
def observations_per_image(v):
    return model.per_image_counts(v("images"), v("obs"))


@query("SELECT least(image_id1, image_id2) * 2147483647 + greatest(image_id1, image_id2) AS pair_id, image_id1 AS a, image_id2 AS b, image_id2 > image_id1 AS other_way, image_id1 > image_id2 AS this_way FROM {sparse}")
def pair_codec(v):
    coded = v("sparse").select(pairs.pair_id(F.col("image_id2"), F.col("image_id1")).alias("pair_id"), "image_id1", "image_id2")
    a, b = pairs.unpair(F.col("pair_id"))
    return coded.select("pair_id", a.alias("a"), b.alias("b"), pairs.swapped(F.col("image_id2"), F.col("image_id1")).alias("other_way"), pairs.swapped(F.col("image_id1"), F.col("image_id2")).alias("this_way"))


def _matches(v):
    listed = F.sort_array(F.collect_list(F.struct(F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"))))  # a pair's matches
    rows = v("matches").groupBy("image_id1", "image_id2").agg(listed.alias("matches"))
    return rows.withColumn("pair_id", pairs.pair_id(F.col("image_id1"), F.col("image_id2"))).withColumn("config", (F.col("pair_id") % 8).cast("int"))


@query("SELECT image_id1 * 2147483647 + image_id2 AS pair_id, count(*) AS inliers FROM {matches} GROUP BY image_id1, image_id2")
def inlier_counts(v):
    return store.inlier_counts(_matches(v))


@query("SELECT image_id2 AS image_id1, image_id1 AS image_id2, idx2 AS idx1, idx1 AS idx2 FROM {matches}")
def swapped_matches(v):
    rows = _matches(v).select("image_id1", "image_id2", F.explode(store.swap_matches(F.col("matches"))).alias("m"))
    return rows.select(F.col("image_id2").alias("image_id1"), F.col("image_id1").alias("image_id2"), F.col("m.idx1").cast("long").alias("idx1"), F.col("m.idx2").cast("long").alias("idx2"))


@query("""SELECT image_id, name FROM {images} WHERE image_id IN (
    SELECT unnest([image_id1, image_id2]) FROM (SELECT image_id1, image_id2 FROM {matches} GROUP BY image_id1, image_id2 HAVING count(*) >= 2 AND (image_id1 * 2147483647 + image_id2) % 8 <> 7)
    WHERE image_id1 % 10 <> 3 AND image_id2 % 10 <> 3) AND image_id % 10 <> 3""")
def usable_images(v):
    edges = _matches(v).filter(store.usable(F.size("matches"), F.col("config"), least=2, ignore_watermarks=True))
    names = v("images").filter("image_id % 10 <> 3").select("name")
    return store.connected_images(v("images"), edges, names).select("image_id", "name")


@query("SELECT image_id1, image_id2, shared FROM {sparse} WHERE image_id1 % 2 = 0 AND image_id2 % 2 = 0")
def induced_subgraph(v):
    return store.induced(v("sparse"), v("images").filter("image_id % 2 = 0")).select("image_id1", "image_id2", "shared")


def _halves(v):
    images, cameras, sparse = v("images").select("image_id", "name", "camera_id"), v("cameras").select("camera_id", "model", "width", "height"), v("sparse").select("image_id1", "image_id2")
    half = lambda k: {
        "cameras": cameras.filter(F.col("camera_id") % 2 == k),
        "images": images.filter(F.col("camera_id") % 2 == k),
        "matches": sparse.filter((F.col("image_id1") % 4 == k) & (F.col("image_id2") % 4 == k)).withColumn("pair_id", pairs.pair_id(F.col("image_id1"), F.col("image_id2"))),
    }
    return half(0), half(1)


@query("""SELECT CASE WHEN camera_id % 2 = 0 THEN image_id ELSE image_id + (SELECT max(image_id) FILTER (WHERE camera_id % 2 = 0) + 1 - min(image_id) FILTER (WHERE camera_id % 2 = 1) FROM {images}) END AS image_id, name,
    CASE WHEN camera_id % 2 = 0 THEN camera_id ELSE camera_id + (SELECT max(camera_id) FILTER (WHERE camera_id % 2 = 0) + 1 - min(camera_id) FILTER (WHERE camera_id % 2 = 1) FROM {cameras}) END AS camera_id FROM {images}""")
def store_merge(v):
    return store.merge(*_halves(v))["images"].select("image_id", "name", "camera_id")


@query("""SELECT part, image_id, name, dense_rank() OVER (ORDER BY name) AS global_id, row_number() OVER (PARTITION BY name ORDER BY part, image_id) = 1 AS wins
    FROM (SELECT unnest([0, 1]) AS part, image_id, name FROM {images}) p WHERE (image_id + part) % 3 > 0""")
def store_merge_by_name(v):
    parts = v("images").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("part"), "image_id", "name").filter("(image_id + part) % 3 > 0")
    return store.merge_by_name(parts)


@query("SELECT image_id + 1000000 AS image_id, idx, point_id FROM {obs} WHERE image_id % 3 = 0")
def remapped(v):
    ids = v("images").filter("image_id % 3 = 0").select(F.col("image_id").alias("old"), (F.col("image_id") + 1000000).alias("new"))
    return store.remap(v("obs").select("image_id", "idx", "point_id"), ids, "image_id").select("image_id", "idx", "point_id")


@query("SELECT image_id, image_id % 6 = 0 AS common FROM {images} WHERE image_id % 2 = 0")
def common_images(v):
    a, b = v("images").filter("image_id % 3 = 0"), v("images").filter("image_id % 2 = 0")
    common, missing = store.common_and_missing(a, b)
    return common.withColumn("common", F.lit(True)).unionByName(missing.withColumn("common", F.lit(False)))


@query("SELECT a.name AS name1, b.name AS name2, count(*) AS inliers FROM {matches} m JOIN {images} a ON a.image_id = m.image_id1 JOIN {images} b ON b.image_id = m.image_id2 GROUP BY a.name, b.name HAVING count(*) >= 2")
def match_export(v):
    from skein.sources.model import inlier_pairs

    return inlier_pairs(_matches(v), v("images"), 2)


@query("SELECT image_id, array_to_string(list(other ORDER BY other), ' ') AS neighbours FROM (SELECT DISTINCT image_id1 AS image_id, image_id2 AS other FROM {sparse} UNION SELECT image_id2, image_id1 FROM {sparse}) t GROUP BY image_id")
def visibility_lists(v):
    return model.visibility_lists(v("sparse")).select("image_id", F.array_join(F.transform("neighbours", lambda x: x.cast("string")), " ").alias("neighbours"))


# Pair generators ---------------------------------------------------------------------


@query("SELECT a.camera_id AS image_id1, b.camera_id AS image_id2 FROM {cameras} a JOIN {cameras} b ON a.camera_id < b.camera_id")
def pairs_exhaustive(v):
    return pairs.exhaustive(v("cameras").select(F.col("camera_id").alias("image_id")))


_SEQUENCE = """SELECT DISTINCT least(a.image_id, b.image_id) AS image_id1, greatest(a.image_id, b.image_id) AS image_id2
    FROM (SELECT image_id, row_number() OVER (ORDER BY reverse(name), image_id) AS p FROM {images}) a
    JOIN (SELECT unnest(%s) AS k) k ON true JOIN (SELECT image_id, row_number() OVER (ORDER BY reverse(name), image_id) AS p FROM {images}) b ON b.p = a.p + k"""


def _by_reversed_name(v):
    return v("images").select("image_id", F.reverse("name").alias("name"))


@query(_SEQUENCE % "[1, 2, 3, 4, 5, 6, 7, 8, 9]")
def pairs_sequential(v):
    return pairs.sequential(_by_reversed_name(v))


@query(_SEQUENCE % "[1, 2, 3, 4, 5, 6, 7, 8, 9, 16, 32, 64, 128, 256, 512]")
def pairs_sequential_quadratic(v):
    return pairs.sequential(_by_reversed_name(v), quadratic=True)


@query("SELECT image_id, p AS position FROM (SELECT image_id, row_number() OVER (ORDER BY reverse(name), image_id) - 1 AS p FROM {images}) t WHERE p % 10 = 0")
def loop_samples(v):
    return pairs.every_nth(_by_reversed_name(v))


@query("""--with
    e AS (SELECT camera_id, 6378137.0 / sqrt(1 - 0.006694379990141317 * sin(radians(lat)) * sin(radians(lat))) AS n, radians(lat) AS la, radians(lon) AS lo FROM {cameras}),
    p AS (SELECT camera_id, n * cos(la) * cos(lo) AS x, n * cos(la) * sin(lo) AS y, n * (1 - 0.006694379990141317) * sin(la) AS z FROM e),
    d AS (SELECT a.camera_id AS a, b.camera_id AS b, (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) AS d2 FROM p a JOIN p b ON a.camera_id <> b.camera_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(d2, 6), b) AS k FROM d WHERE d2 <= 12000.0 * 12000.0)
    SELECT a AS image_id1, b AS image_id2, CAST(k AS INTEGER) AS rank FROM r WHERE k <= 5""")
def pairs_spatial(v):
    located = v("cameras").select(F.col("camera_id").alias("image_id"), "lat", "lon", F.lit(0.0).alias("alt"))
    return pairs.spatial(located, neighbours=5, distance=12_000.0).select("image_id1", "image_id2", "rank")


@query("""--with
    u AS (SELECT image_id1 AS a, image_id2 AS b FROM {sparse} UNION SELECT image_id2, image_id1 FROM {sparse})
    SELECT DISTINCT x.b AS image_id1, y.b AS image_id2 FROM u x JOIN u y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = x.b AND u.b = y.b)""")
def pairs_transitive(v):
    return pairs.transitive(v("sparse").select("image_id1", "image_id2"))


@query("""SELECT image_id1, image_id2, image_id1 * 2147483647 + image_id2 AS pair_id, CASE WHEN image_id1 % 3 > 0 THEN 'verify' ELSE 'match' END AS step
    FROM {sparse} WHERE image_id1 % 3 = 0 OR image_id2 % 2 = 0""")
def pairs_todo(v):
    coded = v("sparse").withColumn("pair_id", pairs.pair_id(F.col("image_id1"), F.col("image_id2")))
    asked = v("sparse").select("image_id2", "image_id1").unionByName(v("sparse").select("image_id2", F.col("image_id2").alias("image_id1")))
    return pairs.work(asked, coded.filter("image_id1 % 3 > 0"), coded.filter("image_id2 % 2 > 0"))


@query("SELECT DISTINCT image_id1, image_id2 FROM {sparse} WHERE image_id1 % 5 = 0")
def pairs_from_list(v):
    named = v("sparse").filter("image_id1 % 5 = 0").join(v("images").select(F.col("image_id").alias("image_id1"), F.col("name").alias("n1")), "image_id1").join(v("images").select(F.col("image_id").alias("image_id2"), F.col("name").alias("n2")), "image_id2")
    lines = named.select(F.concat(F.lit("  "), "n2", F.lit(" "), "n1").alias("value")).unionByName(named.select(F.concat(F.lit("# "), "n1").alias("value"))).unionByName(named.select(F.concat("n1", F.lit(" unknown")).alias("value")))
    return pairs.from_names(pairs.parse_pair_list(lines), v("images"))


@query("SELECT image_id1 + 1 AS src, image_id2 + 1 AS dst, CAST(max(shared) AS DOUBLE) AS score FROM {sparse} GROUP BY image_id1, image_id2")
def similarity_list(v):
    lines = v("sparse").select(F.concat_ws(" ", "image_id1", "image_id2", "shared").alias("value")).unionByName(v("sparse").select(F.concat_ws(" ", "image_id2", "image_id1", F.lit(1)).alias("value"))).unionByName(v("sparse").select(F.concat_ws(" ", "image_id2", "image_id2", F.lit(9)).alias("value")))
    return pairs.similarity_list(lines)


# Model analytics -----------------------------------------------------------------------


@query("""SELECT CAST((SELECT count(*) FROM {images}) AS BIGINT) AS images, count(DISTINCT image_id) AS registered, count(DISTINCT point_id) AS points, count(*) AS observations,
    round(count(*) / CAST(count(DISTINCT point_id) AS DOUBLE), 6) AS mean_track_length, round(count(*) / CAST(count(DISTINCT image_id) AS DOUBLE), 6) AS mean_per_image FROM {obs}""")
def model_stats(v):
    return model.statistics(v("images"), v("obs"))


@query("SELECT image_id1, image_id2, shared FROM {covis} WHERE shared >= 2")
def covisibility(v):
    return model.shared_points(v("obs")).filter("shared >= 2")


_TOP = """SELECT image_id, other, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, other) AS rank
    FROM (SELECT image_id1 AS image_id, image_id2 AS other, shared FROM {covis} UNION ALL SELECT image_id2, image_id1, shared FROM {covis}) b) t WHERE rank <= 3"""


@query(_TOP)
def top_overlap(v):
    return model.top_overlap(model.shared_points(v("obs")))


_POSE = """--with
    z AS (SELECT *, cos(2 * half_yaw) AS c, sin(2 * half_yaw) AS s FROM {seen}),
    e AS (SELECT *, pz + tz AS depth, c * px - s * py + tx AS xx, s * px + c * py + ty AS yy FROM z),
    r AS (SELECT *, CASE WHEN depth > 0 THEN (f * xx / depth + cx - x) * (f * xx / depth + cx - x) + (f * yy / depth + cy - y) * (f * yy / depth + cy - y) ELSE 1.7976931348623157e308 END AS error2,
        -(c * tx + s * ty) AS c0, -(c * ty - s * tx) AS c1, -tz AS c2 FROM e)
"""


@query(_POSE + "SELECT image_id, idx, round(CASE WHEN depth > 0 THEN sqrt(error2) ELSE -1 END, 4) AS error, round(depth, 6) AS depth FROM r")
def reprojection_error(v):
    return model.with_error(v("seen")).select("image_id", "idx", F.round(F.when(F.col("depth") > 0, F.sqrt("error2")).otherwise(F.lit(-1.0)), 4).alias("error"), F.round("depth", 6).alias("depth"))


@query(_POSE + "SELECT image_id, idx, point_id FROM r WHERE depth > 0")
def filter_depth(v):
    return model.filter_depth(model.with_error(v("seen"))).select("image_id", "idx", "point_id")


@query(_POSE + """, k AS (SELECT *, count(*) OVER (PARTITION BY point_id) AS n FROM r WHERE error2 <= 400.0 * 400.0)
    SELECT point_id, count(*) AS n, round(avg(sqrt(error2)), 4) AS error FROM k WHERE n >= 2 GROUP BY point_id""")
def filter_reprojection(v):
    kept = model.filter_reprojection(model.with_error(v("seen")), 400.0)
    return kept.groupBy("point_id").agg(F.count("*").alias("n"), F.round(F.first("point_error"), 4).alias("error"))


_ANGLE = _POSE + """, q AS (SELECT a.point_id, a.image_id AS image_id1, b.image_id AS image_id2,
    (a.c0-b.c0)*(a.c0-b.c0)+(a.c1-b.c1)*(a.c1-b.c1)+(a.c2-b.c2)*(a.c2-b.c2) AS base,
    (a.px-a.c0)*(a.px-a.c0)+(a.py-a.c1)*(a.py-a.c1)+(a.pz-a.c2)*(a.pz-a.c2) AS r1, (b.px-b.c0)*(b.px-b.c0)+(b.py-b.c1)*(b.py-b.c1)+(b.pz-b.c2)*(b.pz-b.c2) AS r2
    FROM r a JOIN r b ON a.point_id = b.point_id AND a.image_id < b.image_id),
    g AS (SELECT *, CASE WHEN r1 = 0 OR r2 = 0 THEN 0 ELSE acos(greatest(-1, least(1, (r1 + r2 - base) / (2 * sqrt(r1 * r2))))) END AS a FROM q),
    h AS (SELECT point_id, image_id1, image_id2, least(a, pi() - a) AS angle FROM g)
"""


@query(_ANGLE + "SELECT point_id, round(max(angle), 6) AS angle FROM h GROUP BY point_id")
def widest_angle(v):
    return model.pair_angles(v("seen")).groupBy("point_id").agg(F.round(F.max("angle"), 6).alias("angle"))


@query(_ANGLE + ", w AS (SELECT point_id FROM h GROUP BY point_id HAVING max(angle) >= radians(60)) SELECT image_id, idx, point_id FROM r WHERE point_id IN (SELECT point_id FROM w)")
def filter_angle(v):
    return model.filter_angle(v("seen"), 60.0).select("image_id", "idx", "point_id")


@query(_ANGLE + """SELECT image_id1, image_id2, round(list_sort(list(angle))[CAST(floor(0.75 * (count(*) - 1) + 0.5) AS BIGINT) + 1], 6) AS angle FROM h GROUP BY image_id1, image_id2 HAVING count(*) > 1""")
def angle_percentile(v):
    angles = model.pair_angles(v("seen"))
    several = angles.groupBy("image_id1", "image_id2").agg(F.count("*").alias("n")).filter("n > 1").select("image_id1", "image_id2")
    return model.angle_percentile(angles.join(several, ["image_id1", "image_id2"], "left_semi")).select("image_id1", "image_id2", F.round("angle", 6).alias("angle"))


@query(_POSE + """, d AS (SELECT image_id, list_sort(list(depth) FILTER (WHERE depth > 0)) AS l FROM r GROUP BY image_id)
    SELECT image_id, round(CASE WHEN l IS NULL OR len(l) = 0 THEN -1 ELSE l[CAST(floor(len(l) * 0.01::DOUBLE) AS BIGINT) + 1] * 0.75 END, 6) AS near,
    round(CASE WHEN l IS NULL OR len(l) = 0 THEN -1 ELSE l[CAST(least(floor(len(l) * 0.99::DOUBLE), len(l) - 1) AS BIGINT) + 1] * 1.25 END, 6) AS far FROM d""")
def depth_ranges(v):
    return model.depth_ranges(model.with_error(v("seen"))).select("image_id", F.round("near", 6).alias("near"), F.round("far", 6).alias("far"))


@query("""SELECT image_id, CAST(sum(n * pow(4, level)) AS BIGINT) AS score FROM (SELECT image_id, level, count(DISTINCT cx * 100 + cy) AS n FROM (
    SELECT image_id, level, least(greatest(CAST(floor(x * 64 / 110000.0) AS BIGINT), 0), 63) // CAST(pow(2, 6 - level) AS BIGINT) AS cx, least(greatest(CAST(floor(y * 64 / 60.0) AS BIGINT), 0), 63) // CAST(pow(2, 6 - level) AS BIGINT) AS cy
    FROM {obs}, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS level) l) c GROUP BY image_id, level) n GROUP BY image_id""")
def visibility_score(v):
    return model.visibility(v("obs"), 110_000.0, 60.0)


@query("SELECT point_id, count(*) AS length FROM {obs} GROUP BY point_id HAVING count(*) BETWEEN 20 AND 30")
def track_lengths(v):
    return model.track_lengths(v("obs"), 20, 30)


@query("SELECT image_id, idx, point_id FROM {obs} WHERE point_id IN (SELECT point_id FROM {obs} GROUP BY point_id HAVING count(*) >= 30)")
def short_tracks_dropped(v):
    return model.short_tracks_dropped(v("obs"), 30).select("image_id", "idx", "point_id")


@query("SELECT l_orderkey AS image_id, l_partkey AS point_id, min(l_linenumber * 1000 + l_suppkey) AS first FROM {lineitem} GROUP BY l_orderkey, l_partkey")
def one_per_image(v):
    rows = v("lineitem").select(F.col("l_orderkey").alias("image_id"), F.col("l_partkey").alias("point_id"), (F.col("l_linenumber") * 1000 + F.col("l_suppkey")).alias("first"))
    return model.one_per_image(rows, order=["first"])


@query(_POSE + "SELECT point_id, CAST(least(count(*), 25) AS BIGINT) AS length, round(avg(error2), 2) AS mean_error2 FROM r WHERE depth > 0 GROUP BY point_id")
def track_stats(v):
    return model.track_statistics(model.with_error(v("seen")).filter("depth > 0"), 25).select("point_id", F.col("length").cast("long").alias("length"), F.round("mean_error2", 2).alias("mean_error2"))


@query(_POSE + """, t AS (SELECT point_id, least(count(*), 25) AS length, avg(error2) AS m FROM r WHERE depth > 0 GROUP BY point_id)
    SELECT image_id, cx, cy, point_id FROM (SELECT image_id, cx, cy, r.point_id, row_number() OVER (PARTITION BY image_id, cx, cy ORDER BY length, round(m, 6), r.point_id) AS k
    FROM (SELECT image_id, point_id, CAST(trunc(x / 100) AS INTEGER) AS cx, CAST(trunc(y / 100) AS INTEGER) AS cy FROM r WHERE depth > 0) r JOIN t ON r.point_id = t.point_id) q WHERE k = 1""")
def grid_best_track(v):
    seen = model.with_error(v("seen")).filter("depth > 0")
    return model.grid_best(seen, model.track_statistics(seen, 25))


@query("""SELECT a.point_id AS id1, b.point_id AS id2, round((a.px * a.w + b.px * b.w) / (a.w + b.w), 6) AS px, round((a.py * a.w + b.py * b.w) / (a.w + b.w), 6) AS py, round((a.pz * a.w + b.pz * b.w) / (a.w + b.w), 6) AS pz
    FROM (SELECT p.*, w FROM {points} p JOIN (SELECT point_id, count(*) AS w FROM {obs} GROUP BY point_id) o ON p.point_id = o.point_id WHERE p.point_id % 2 = 0) a
    JOIN (SELECT p.*, w FROM {points} p JOIN (SELECT point_id, count(*) AS w FROM {obs} GROUP BY point_id) o ON p.point_id = o.point_id) b ON b.point_id = a.point_id + 1""")
def merge_points(v):
    sized = v("points").join(v("obs").groupBy("point_id").agg(F.count("*").alias("w")), "point_id").select("point_id", "px", "py", "pz", "w")
    a = sized.filter("point_id % 2 = 0").select(*[F.col(c).alias("a_" + c) for c in sized.columns], (F.col("point_id") + 1).alias("next"))
    b = sized.select(*[F.col(c).alias("b_" + c) for c in sized.columns])
    rows = a.join(b, F.col("next") == F.col("b_point_id"))
    return rows.select(F.col("a_point_id").alias("id1"), F.col("b_point_id").alias("id2"), *[F.round(c, 6).alias(n) for c, n in zip(model.merge_two("a_", "b_", ["px", "py", "pz"], "a_w", "b_w"), ("px", "py", "pz"))])


@query("SELECT o.point_id, CAST(floor(avg(i.r)) AS INTEGER) AS r, CAST(floor(avg(i.g)) AS INTEGER) AS g, CAST(floor(avg(i.b)) AS INTEGER) AS b FROM {obs} o JOIN (SELECT image_id, image_id % 256 AS r, image_id % 199 AS g, image_id % 97 AS b FROM {images}) i ON o.image_id = i.image_id GROUP BY o.point_id")
def mean_colours(v):
    colours = v("images").select("image_id", (F.col("image_id") % 256).alias("r"), (F.col("image_id") % 199).alias("g"), (F.col("image_id") % 97).alias("b"))
    return model.mean_colours(v("obs"), colours)


@query("""--with
    a AS (SELECT 'x' AS axis, px AS v, row_number() OVER (ORDER BY px) - 1 AS i FROM {points} UNION ALL SELECT 'y', py, row_number() OVER (ORDER BY py) - 1 FROM {points} UNION ALL SELECT 'z', pz, row_number() OVER (ORDER BY pz) - 1 FROM {points}),
    b AS (SELECT *, CAST(floor(0.1::DOUBLE * (count(*) OVER (PARTITION BY axis) - 1)) AS BIGINT) AS p0, CAST(floor(0.9::DOUBLE * (count(*) OVER (PARTITION BY axis) - 1)) AS BIGINT) AS p1 FROM a)
    SELECT axis, max(v) FILTER (WHERE i = p0) AS low, max(v) FILTER (WHERE i = p1) AS high, round(avg(v) FILTER (WHERE i BETWEEN p0 AND p1), 6) AS mean FROM b GROUP BY axis""")
def bounding_box(v):
    return model.bounding_box(v("points")).select("axis", "low", "high", F.round("mean", 6).alias("mean"))


@query("""SELECT i.image_id FROM {images} i JOIN {cameras} c ON i.camera_id = c.camera_id LEFT JOIN (SELECT DISTINCT image_id FROM {obs}) o ON i.image_id = o.image_id
    WHERE o.image_id IS NULL OR abs(k1) > 0.035 OR f / 1024 > 0.75""")
def filter_images(v):
    return model.images_to_drop(v("images"), v("cameras"), v("obs"), max_focal=0.75, max_extra=0.035)


@query("SELECT image_id FROM {images} WHERE image_id NOT IN (SELECT image_id FROM {obs} GROUP BY image_id HAVING count(*) >= 3)")
def images_with_few(v):
    return model.per_image_counts(v("images"), v("obs")).filter("observations < 3").select("image_id")


@query("""SELECT image_id1, image_id2, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT s.*, row_number() OVER (PARTITION BY image_id1 ORDER BY CAST(c.prior_focal AS INTEGER) DESC, shared DESC, image_id2) AS rank
    FROM {sparse} s JOIN {images} i ON s.image_id2 = i.image_id JOIN {cameras} c ON i.camera_id = c.camera_id) t""")
def initial_pairs(v):
    return model.initial_pairs(v("cameras"), v("images"), v("sparse")).select("image_id1", "image_id2", "shared", "rank")


@query("""SELECT i.image_id, CAST(row_number() OVER (ORDER BY trials, n DESC, i.image_id) AS INTEGER) AS rank FROM (SELECT image_id, image_id % 2 AS trials FROM {images}) i
    JOIN (SELECT image_id, count(*) AS n FROM {obs} GROUP BY image_id) o ON i.image_id = o.image_id""")
def next_images(v):
    rows = v("images").select("image_id", (F.col("image_id") % 2).alias("trials")).join(v("obs").groupBy("image_id").agg(F.count("*").alias("n")), "image_id")
    return model.next_images(rows, "n").select("image_id", "rank")


# Correspondences ---------------------------------------------------------------------------


_CORR = """--with
    c AS (SELECT image_id1 AS image_id, idx1 AS idx, image_id2 AS other, idx2 AS other_idx FROM {matches} UNION ALL SELECT image_id2, idx2, image_id1, idx1 FROM {matches})
"""


@query(_CORR + "SELECT image_id, count(DISTINCT idx) AS features, count(*) AS correspondences FROM c GROUP BY image_id")
def correspondence_counts(v):
    return model.correspondence_counts(model.correspondences(v("matches")))


@query("SELECT image_id1, image_id2, count(*) AS correspondences FROM {matches} GROUP BY image_id1, image_id2")
def pair_counts(v):
    return model.pair_counts(model.correspondences(v("matches")))


@query(_CORR + """, d AS (SELECT image_id, idx FROM c GROUP BY image_id, idx HAVING count(*) = 1)
    SELECT c.image_id, c.idx FROM c JOIN d ON c.image_id = d.image_id AND c.idx = d.idx JOIN d e ON c.other = e.image_id AND c.other_idx = e.idx""")
def two_view_observations(v):
    return model.two_view_observations(model.correspondences(v("matches")))


@query(_CORR + """, s AS (SELECT DISTINCT image_id, idx FROM c),
    one AS (SELECT s.image_id AS s, s.idx AS si, c.other AS i, c.other_idx AS x FROM s JOIN c ON s.image_id = c.image_id AND s.idx = c.idx),
    two AS (SELECT one.s, one.si, c.other AS i, c.other_idx AS x FROM one JOIN c ON one.i = c.image_id AND one.x = c.idx)
    SELECT s, si AS sidx, i AS image_id, x AS idx, CAST(min(k) AS INTEGER) AS depth FROM (SELECT *, 1 AS k FROM one UNION ALL SELECT *, 2 FROM two) t WHERE NOT (s = i AND si = x) GROUP BY ALL""")
def transitive_correspondences(v):
    corr = cut(model.correspondences(v("matches")))
    return model.reachable(corr, corr.select("image_id", "idx").distinct(), 2)


@query(_CORR + "SELECT c.image_id, count(DISTINCT c.idx) AS visible FROM c JOIN {obs} o ON c.other = o.image_id AND c.other_idx = o.idx WHERE o.point_id % 2 = 0 GROUP BY c.image_id")
def visible_points(v):
    return model.visible_points(model.correspondences(v("matches")), v("obs").withColumn("point_id", F.when(F.col("point_id") % 2 == 0, F.col("point_id"))))


@query("""SELECT image_id1, image_id2, count(*) AS total, CAST(sum(CASE WHEN a.point_id % 3 > 0 THEN 1 ELSE 0 END) AS BIGINT) AS triangulated FROM {matches} m JOIN {obs} a ON a.image_id = m.image_id1 AND a.idx = m.idx1 GROUP BY image_id1, image_id2""")
def pair_statistics(v):
    obs = v("obs").withColumn("point_id", F.when(F.col("point_id") % 3 > 0, F.col("point_id")))
    return model.pair_statistics(model.correspondences(v("matches")), obs).select("image_id1", "image_id2", "total", F.coalesce("triangulated", F.lit(0)).cast("long").alias("triangulated"))


@query("""SELECT 2 * (SELECT count(*) FROM {obs} WHERE image_id IN (SELECT image_id FROM {images} JOIN {cameras} USING (camera_id) WHERE prior_focal) OR point_id IN (SELECT point_id FROM {obs} WHERE image_id IN (SELECT image_id FROM {images} JOIN {cameras} USING (camera_id) WHERE prior_focal))) AS residuals""")
def bundle_residuals(v):
    return model.bundle_residuals(v("obs"), v("images").join(v("cameras").filter("prior_focal").select("camera_id"), "camera_id", "left_semi"))


# Geometry expressions --------------------------------------------------------------------------


@query("""--with
    e AS (SELECT image_id, alt, 6378137.0 / sqrt(1 - 0.006694379990141317 * sin(radians(lat)) * sin(radians(lat))) AS n, radians(lat) AS la, radians(lon) AS lo FROM {images})
    SELECT image_id, round((n + alt) * cos(la) * cos(lo), 4) AS x, round((n + alt) * cos(la) * sin(lo), 4) AS y, round((n * (1 - 0.006694379990141317) + alt) * sin(la), 4) AS z FROM e""")
def gps_to_xyz(v):
    x, y, z = g.ellipsoid_to_xyz(F.col("lat"), F.col("lon"), F.col("alt"))
    return v("images").select("image_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(z, 4).alias("z"))


@query("""SELECT a.image_id AS image_id1, b.image_id AS image_id2, round(cos(b.half_yaw - a.half_yaw), 6) AS qw, round(sin(b.half_yaw - a.half_yaw), 6) AS qz,
    round(b.tx - (cos(2 * (b.half_yaw - a.half_yaw)) * a.tx - sin(2 * (b.half_yaw - a.half_yaw)) * a.ty), 6) AS tx,
    round(b.ty - (sin(2 * (b.half_yaw - a.half_yaw)) * a.tx + cos(2 * (b.half_yaw - a.half_yaw)) * a.ty), 6) AS ty, round(b.tz - a.tz, 6) AS tz
    FROM {images} a JOIN {images} b ON b.image_id = a.image_id + 1""")
def relative_poses(v):
    a = v("images").select(F.col("image_id").alias("image_id1"), *[F.col(c).alias("a_" + c) for c in ("half_yaw", "tx", "ty", "tz")], (F.col("image_id") + 1).alias("image_id2"))
    b = v("images").select(F.col("image_id").alias("image_id2"), *[F.col(c).alias("b_" + c) for c in ("half_yaw", "tx", "ty", "tz")])
    q, t = g.relative_pose(*model.pose("a_"), *model.pose("b_"))
    return a.join(b, "image_id2").select("image_id1", "image_id2", F.round(q[0], 6).alias("qw"), F.round(q[3], 6).alias("qz"), *[F.round(c, 6).alias(n) for c, n in zip(t, ("tx", "ty", "tz"))])


@query("""SELECT image_id, round(-(cos(2 * half_yaw) * tx + sin(2 * half_yaw) * ty), 6) AS x, round(-(cos(2 * half_yaw) * ty - sin(2 * half_yaw) * tx), 6) AS y, round(-tz, 6) AS z FROM {images}""")
def camera_centres(v):
    c = g.centre(*model.pose())
    return v("images").select("image_id", *[F.round(x, 6).alias(n) for x, n in zip(c, "xyz")])


@query("SELECT point_id, round(2 * (-py) + 1, 6) AS x, round(2 * px + 2, 6) AS y, round(2 * pz + 3, 6) AS z FROM {points}")
def similarity_transform(v):
    q = (F.lit(math.sqrt(0.5)), F.lit(0.0), F.lit(0.0), F.lit(math.sqrt(0.5)))
    out = g.transform(F.lit(2.0), q, g.vector(1.0, 2.0, 3.0), g.vector("px", "py", "pz"))
    return v("points").select("point_id", *[F.round(x, 6).alias(n) for x, n in zip(out, "xyz")])


@query("""SELECT camera_id, p AS point_id, round(f * (1 + CASE WHEN model >= 2 THEN k1 * (u * u + w * w) ELSE 0 END) * u + cx, 6) AS x, round(f * (1 + CASE WHEN model >= 2 THEN k1 * (u * u + w * w) ELSE 0 END) * w + cy, 6) AS y
    FROM (SELECT c.*, p.point_id AS p, px / (pz + 50) AS u, py / (pz + 50) AS w FROM {cameras} c JOIN {points} p ON p.point_id % 100 = c.camera_id) t""")
def projections(v):
    rows = v("cameras").join(v("points"), F.col("point_id") % 100 == F.col("camera_id"))
    x, y = g.project(F.col("model"), F.col("f"), F.col("cx"), F.col("cy"), F.col("k1"), (F.col("px"), F.col("py"), F.col("pz") + 50))
    return rows.select("camera_id", "point_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"))


@query("""SELECT o_orderkey AS id, round(1 / (1 + exp(-CAST(o_orderkey % 9 - 4 AS DOUBLE))), 6) AS sigmoid, CAST(CASE WHEN o_orderkey % 12 < o_orderkey % 4 THEN 0 ELSE factorial(CAST(o_orderkey % 12 AS INTEGER)) / (factorial(CAST(o_orderkey % 4 AS INTEGER)) * factorial(greatest(0, CAST(o_orderkey % 12 - o_orderkey % 4 AS INTEGER)))) END AS BIGINT) AS choose,
    least(greatest(CAST(o_orderkey % 400 - 50 AS INTEGER), 0), 255) AS clipped, round(radians(o_orderkey % 360), 6) AS rad, o_orderkey % 100 + 1 AS samples FROM {orders}""")
def scalar_functions(v):
    k = F.col("o_orderkey")
    return v("orders").select(
        k.alias("id"), F.round(s.sigmoid((k % 9 - 4).cast("double")), 6).alias("sigmoid"), s.choose(k % 12, k % 4).alias("choose"),
        s.truncated(k % 400 - 50).alias("clipped"), F.round(F.radians(k % 360), 6).alias("rad"), (k % 100 + 1).alias("samples"),
    )


@query("""SELECT page_id, string_split(url, '/')[-1] AS base, regexp_replace(url, '/[^/]*$', '') AS parent, CASE WHEN contains(url, '//') THEN string_split(url, '//')[-1] ELSE '' END AS after,
    array_to_string([x FOR x IN regexp_split_to_array(url, '[/:]') IF x <> ''], '|') AS parts FROM {pages}""")
def string_functions(v):
    url = F.col("url")
    return v("pages").select("page_id", s.base_name(url).alias("base"), s.parent_dir(url).alias("parent"), s.after_last(url, "//").alias("after"), F.array_join(s.split_any(url, "/:"), "|").alias("parts"))


@query("""SELECT o_orderkey % 50 AS k, count(*) AS n, round(median(o_totalprice), 4) AS median, round(avg(o_totalprice), 4) AS mean, round(var_samp(o_totalprice), 2) AS variance,
    round(list_sort(list(o_totalprice))[CAST(floor(0.75 * (count(*) - 1) + 0.5) AS BIGINT) + 1], 4) AS p75 FROM {orders} GROUP BY o_orderkey % 50""")
def group_statistics(v):
    price = F.col("o_totalprice")
    rows = v("orders").groupBy((F.col("o_orderkey") % 50).alias("k"))
    return rows.agg(F.count("*").alias("n"), F.round(F.median(price), 4).alias("median"), F.round(F.avg(price), 4).alias("mean"), F.round(F.var_samp(price), 2).alias("variance"), F.round(s.percentile_of(price, 75.0), 4).alias("p75"))


@query("""SELECT o_orderkey AS k, CAST(CASE WHEN o_orderkey % 100 = 99 THEN 1 ELSE greatest(1, ceil(ln(1 - 0.999::DOUBLE) / ln(1 - pow((o_orderkey % 100 + 1) / 100.0::DOUBLE, 3)))) END AS BIGINT) AS trials FROM {orders}""")
def ransac_trials(v):
    inliers = (F.col("o_orderkey") % 100 + 1).cast("double")
    return v("orders").select(F.col("o_orderkey").alias("k"), s.ransac_trials(inliers, F.lit(100.0), F.lit(0.999)).alias("trials"))


@query("SELECT name, ln(1 + n) / ln(1 + most) AS unused, round(ln(1 + n) / ln(1 + most), 6) AS value FROM (SELECT CAST(src AS VARCHAR) || '-' || CAST(dst AS VARCHAR) AS name, weight AS n, max(weight) OVER () AS most FROM {dense}) t".replace("ln(1 + n) / ln(1 + most) AS unused, ", ""))
def match_matrix(v):
    most = v("dense").agg(F.max("weight").alias("most"))
    return v("dense").crossJoin(F.broadcast(most)).select(F.concat_ws("-", "src", "dst").alias("name"), F.round(F.log1p("weight") / F.log1p("most"), 6).alias("value"))


# Graphs ------------------------------------------------------------------------------------------


def _sparse_edges(v):
    return v("sparse").select(F.col("image_id1").alias("src"), F.col("image_id2").alias("dst"), F.col("shared").alias("weight"))


def _nodes(v):
    return v("images").select(F.col("image_id").alias("id"))


@query("""SELECT i.image_id AS id, CAST(coalesce(n_in, 0) AS BIGINT) AS in_degree, CAST(coalesce(n_out, 0) AS BIGINT) AS out_degree, CAST(coalesce(n_in, 0) + coalesce(n_out, 0) AS BIGINT) AS degree FROM {images} i
    LEFT JOIN (SELECT image_id2 AS id, count(*) AS n_in FROM {sparse} GROUP BY image_id2) a ON a.id = i.image_id LEFT JOIN (SELECT image_id1 AS id, count(*) AS n_out FROM {sparse} GROUP BY image_id1) b ON b.id = i.image_id""")
def degrees(v):
    return graph.degrees(_nodes(v), _sparse_edges(v))


@query("""SELECT round(var_pop(d) / avg(d), 6) AS dispersion, CASE WHEN var_pop(d) / avg(d) >= 4 THEN 'HYBRID' ELSE 'NCUT' END AS method FROM (SELECT i.image_id, count(s.image_id1) AS d FROM {images} i LEFT JOIN {sparse} s ON i.image_id = s.image_id1 OR i.image_id = s.image_id2 GROUP BY i.image_id) t""")
def degree_dispersion(v):
    return graph.degree_dispersion(_nodes(v), _sparse_edges(v))


@query("SELECT image_id AS id FROM {images} WHERE image_id NOT IN (SELECT image_id1 FROM {sparse}) AND image_id NOT IN (SELECT image_id2 FROM {sparse})")
def singletons(v):
    return graph.singletons(_nodes(v), _sparse_edges(v))


@query("SELECT id FROM (SELECT image_id1 AS id FROM {sparse} UNION ALL SELECT image_id2 FROM {sparse}) t GROUP BY id HAVING count(*) = 1")
def leaf_nodes(v):
    return graph.leaves(_sparse_edges(v))


@query("SELECT a.n AS src, b.n AS dst, s.shared AS weight FROM {sparse} s JOIN (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS n FROM {images}) a ON a.image_id = s.image_id1 JOIN (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS n FROM {images}) b ON b.image_id = s.image_id2")
def relabelled(v):
    return graph.relabelled(_nodes(v), _sparse_edges(v))[1]


_CLOSURE = """RECURSIVE
    u AS (SELECT image_id1 AS a, image_id2 AS b FROM {sparse} UNION SELECT image_id2, image_id1 FROM {sparse}),
    t AS (SELECT a AS id, a AS c FROM u UNION SELECT t.id, u.b FROM t JOIN u ON t.c = u.a),
    l AS (SELECT id, min(c) AS component FROM t GROUP BY id)
"""


@query(_CLOSURE + "SELECT i.image_id AS id, coalesce(component, i.image_id) AS component FROM {images} i LEFT JOIN l ON l.id = i.image_id")
def components(v):
    return graph.components(_nodes(v), _sparse_edges(v))


@query(_CLOSURE + ", z AS (SELECT component, count(*) AS n FROM l GROUP BY component ORDER BY n DESC, component LIMIT 1) SELECT src, dst, weight FROM (SELECT image_id1 AS src, image_id2 AS dst, shared AS weight FROM {sparse}) e JOIN l ON l.id = e.src JOIN z ON z.component = l.component")
def largest_component(v):
    return graph.largest_subgraph(_sparse_edges(v))


@query(_CLOSURE + "SELECT a.id AS a, b.id AS b, a.component = b.component AS same FROM l a JOIN l b ON b.id = a.id + 7")
def same_component(v):
    labels = cut(graph.components(graph.nodes_of(_sparse_edges(v)), _sparse_edges(v)))
    asked = labels.select(F.col("id").alias("a"), (F.col("id") + 7).alias("b"))
    return graph.same_component(labels, asked)


@query("SELECT DISTINCT a.src AS a, a.dst AS b, b.dst AS c FROM {viewgraph} a JOIN {viewgraph} b ON a.dst = b.src JOIN {viewgraph} c ON c.src = a.src AND c.dst = b.dst")
def triangles(v):
    return graph.triangles(v("viewgraph").select("src", "dst")).select("a", "b", "c")


_LOOP = """--with
    t AS (SELECT a.src AS a, a.dst AS b, b.dst AS c, abs((((a.turn + b.turn - c.turn + 180) % 360) + 360) % 360 - 180) AS error FROM {viewgraph} a JOIN {viewgraph} b ON a.dst = b.src JOIN {viewgraph} c ON c.src = a.src AND c.dst = b.dst),
    k AS (SELECT a AS src, b AS dst FROM t WHERE error < 1.2 UNION SELECT a, c FROM t WHERE error < 1.2 UNION SELECT b, c FROM t WHERE error < 1.2)
"""


@query(_LOOP + "SELECT e.src, e.dst, weight, turn FROM {viewgraph} e JOIN k ON e.src = k.src AND e.dst = k.dst")
def cycle_filter(v):
    edges = cut_packed(v("viewgraph"))
    return graph.consistent_edges(edges, "turn", lambda ab, ac, bc: np.abs((ab + bc - ac + 180) % 360 - 180), 1.2)


@query("SELECT src, dst, weight, turn FROM {viewgraph} WHERE src % 10 <> 3 AND dst % 10 <> 3 AND abs((((dst * 7 - src * 7 - turn + 180) % 360) + 360) % 360 - 180) <= 0.6")
def orientation_filter(v):
    rotations = graph.nodes_of(v("viewgraph")).filter("id % 10 <> 3").select("id", (F.col("id") * 7).cast("double").alias("turn"))
    return graph.orientation_filter(v("viewgraph"), rotations, 0.6)


@query("""--with
    u AS (SELECT image_id1 AS a, image_id2 AS b FROM {sparse} UNION SELECT image_id2, image_id1 FROM {sparse})
    SELECT x.b AS a, y.b AS b, x.a AS via FROM u x JOIN u y ON x.a = y.a AND x.b < y.b WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.a = x.b AND u.b = y.b)""")
def open_wedges(v):
    return graph.open_wedges(_sparse_edges(v))


@query("""RECURSIVE
    u AS (SELECT src AS a, dst AS b FROM {viewgraph} UNION SELECT dst, src FROM {viewgraph}),
    d AS (SELECT CAST(0 AS BIGINT) AS id, 0 AS k UNION SELECT u.b, d.k + 1 FROM d JOIN u ON d.id = u.a WHERE d.k < 40)
    SELECT id, min(k) AS distance FROM d GROUP BY id""")
def bfs_distance(v):
    edges = v("viewgraph").select("src", "dst", "weight")
    return graph.distances(edges, 0).select("id", "distance")


@query("""--with
    l AS (SELECT camera_id AS id, camera_id % 5 AS label FROM {cameras}), e AS (SELECT src, dst, weight FROM {dense})
    SELECT min(a.label) AS l1, max(b.label) AS l2, count(*) AS n, CAST(sum(weight) AS BIGINT) AS weight FROM e JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.label <> b.label GROUP BY least(a.label, b.label), greatest(a.label, b.label)""".replace("min(a.label)", "least(min(a.label), min(b.label))").replace("max(b.label)", "greatest(max(a.label), max(b.label))"))
def lost_edges(v):
    labels = v("cameras").select(F.col("camera_id").alias("id"), (F.col("camera_id") % 5).alias("label"))
    return partition.split_edges(v("dense"), labels)[1].groupBy("l1", "l2").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def _members(v):
    return v("images").select((F.col("image_id") % 7).alias("label"), F.col("image_id").alias("id")).unionByName(v("images").filter("image_id % 3 = 0").select((F.col("image_id") % 5).alias("label"), F.col("image_id").alias("id"))).distinct()


_MEMBERS = "m AS (SELECT image_id % 7 AS label, image_id AS id FROM {images} UNION SELECT image_id % 5, image_id FROM {images} WHERE image_id % 3 = 0)"


@query("--with\n" + _MEMBERS + " SELECT a.label AS label1, b.label AS label2, count(*) AS common FROM m a JOIN m b ON a.id = b.id AND a.label < b.label GROUP BY a.label, b.label")
def cluster_overlap(v):
    return partition.common_nodes(_members(v))


@query("--with\n" + _MEMBERS + ", c AS (SELECT a.label, count(*) AS common FROM m a JOIN m b ON a.id = b.id AND a.label <> b.label GROUP BY a.label) SELECT m.label, count(*) AS n, round(coalesce(any_value(common), 0) / CAST(count(*) AS DOUBLE), 6) AS ratio FROM m LEFT JOIN c ON m.label = c.label GROUP BY m.label")
def repeated_ratio(v):
    return partition.repeated_ratio(_members(v))


@query("""--with
    l AS (SELECT camera_id AS id, camera_id % 5 AS label FROM {cameras}),
    e AS (SELECT a.label AS la, b.label AS lb, weight FROM {dense} JOIN l a ON a.id = src JOIN l b ON b.id = dst),
    s AS (SELECT la AS label, weight, la <> lb AS cut FROM e UNION ALL SELECT lb, weight, la <> lb FROM e)
    SELECT label, CAST(sum(weight) AS BIGINT) AS volume, CAST(sum(CASE WHEN cut THEN weight ELSE 0 END) AS BIGINT) AS cut, round(sum(CASE WHEN cut THEN weight ELSE 0 END) / CAST(sum(weight) AS DOUBLE), 6) AS share FROM s GROUP BY label""")
def cut_values(v):
    labels = v("cameras").select(F.col("camera_id").alias("id"), (F.col("camera_id") % 5).alias("label"))
    return graph.cut_values(v("dense"), labels)


# Retrieval ------------------------------------------------------------------------------------------


@query("SELECT word, count(DISTINCT doc_id) AS df, round(ln((SELECT count(DISTINCT doc_id) FROM {words}) / CAST(count(DISTINCT doc_id) AS DOUBLE)), 6) AS idf FROM {words} GROUP BY word")
def idf(v):
    return retrieval.idf(v("words")).select("word", "df", F.round("idf", 6).alias("idf"))


_IDF = "i AS (SELECT word, ln((SELECT count(DISTINCT doc_id) FROM {words}) / CAST(count(DISTINCT doc_id) AS DOUBLE)) AS idf FROM {words} GROUP BY word)"


@query("--with\n" + _IDF + " SELECT doc_id, round(sum(tf * idf * idf), 3) AS self FROM {words} JOIN i USING (word) WHERE idf > 0 GROUP BY doc_id HAVING sum(tf * idf * idf) > 0")
def doc_norms(v):
    weights = retrieval.idf(v("words")).filter("idf > 0")
    return retrieval.norms(v("words"), weights).filter("self > 0").select("doc_id", F.round("self", 3).alias("self"))


@query("--with\n" + _IDF + """, q AS (SELECT item_id AS query_id, word, count(*) AS qtf FROM (SELECT item_id, unnest(string_split(lower(text), ' ')) AS word FROM {benchmark}) t WHERE word <> '' GROUP BY item_id, word),
    n AS (SELECT doc_id, sum(tf * idf * idf) AS self FROM {words} JOIN i USING (word) WHERE idf > 0 GROUP BY doc_id), qn AS (SELECT query_id, sum(qtf * idf * idf) AS self FROM q JOIN i USING (word) WHERE idf > 0 GROUP BY query_id),
    s AS (SELECT query_id, doc_id, sum(qtf * idf * idf * sqrt(tf)) AS score FROM q JOIN i USING (word) JOIN {words} w USING (word) WHERE idf > 0 GROUP BY query_id, doc_id),
    r AS (SELECT query_id, s.doc_id, round(score / sqrt(n.self) / sqrt(qn.self), 6) AS score FROM s JOIN n ON n.doc_id = s.doc_id JOIN qn USING (query_id))
    SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) t WHERE rank <= 5""")
def tfidf_topk(v):
    words = F.explode(F.split(F.lower("text"), " "))
    queries = v("benchmark").select(F.col("item_id").alias("query_id"), words.alias("word")).filter("word <> ''").groupBy("query_id", "word").agg(F.count("*").alias("qtf"))
    return retrieval.search(queries, v("words"), 5).select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


@query("""--with
    b AS (SELECT vec_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM {embeddings}),
    h AS (SELECT a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(range(1, 65), lambda i: CASE WHEN a.bits[i] <> b.bits[i] THEN 1 ELSE 0 END)) AS d FROM b a JOIN b ON a.vec_id < b.vec_id AND a.label = b.label)
    SELECT a, b, CAST(d AS INTEGER) AS distance, round(exp(-d * d / 256.0), 6) AS weight FROM h WHERE d <= 24""")
def hamming_score(v):
    rows = v("embeddings").select("vec_id", "label", s.pack_bits(F.transform("embedding", lambda x: x > 0)).alias("sig"))
    both = rows.select(F.col("vec_id").alias("a"), F.col("sig").alias("x"), "label").join(rows.select(F.col("vec_id").alias("b"), "sig", "label"), "label").filter("a < b")
    near = both.select("a", "b", F.bit_count(F.col("x").bitwiseXOR(F.col("sig"))).alias("distance")).filter("distance <= 24")
    return near.select("a", "b", "distance", F.round(s.hamming_weight(F.col("distance")), 6).alias("weight"))


_PRODUCT = "list_sum(list_transform(range(1, 65), lambda i: CAST(a.embedding[i] AS DOUBLE) * b.embedding[i]))"


@query(f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, score FROM (SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6) DESC, vec_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id, {_PRODUCT} AS score FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id) p) t WHERE rank <= 10""")
def cosine_topk(v):
    return retrieval.similarities(v("embeddings").filter("vec_id % 100 = 0"), v("embeddings"), 10)


@query("""SELECT a.vec_id AS a, b.vec_id AS b, round(list_sum(list_transform(range(0, 4), lambda i: list_max(list_transform(range(0, 4), lambda j: list_sum(list_transform(range(1, 17), lambda k: CAST(a.embedding[16 * i + k] AS DOUBLE) * b.embedding[16 * j + k])))))), 4) AS score
    FROM {embeddings} a JOIN {embeddings} b ON b.vec_id = a.vec_id + 1""")
def region_similarity(v):
    a = v("embeddings").select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"), (F.col("vec_id") + 1).alias("b"))
    rows = a.join(v("embeddings").select(F.col("vec_id").alias("b"), F.col("embedding").alias("v")), "b")
    return rows.select("a", "b", F.round(retrieval.region_similarity(rows), 4).alias("score"))


@query(f"""--with
    p AS (SELECT a.vec_id AS query_id, b.vec_id, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_PRODUCT}, 6) DESC, b.vec_id) AS rank FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
    z AS (SELECT query_id, count(*) AS size FROM p WHERE hit GROUP BY query_id),
    r AS (SELECT query_id, rank, sum(CAST(hit AS INTEGER)) OVER (PARTITION BY query_id ORDER BY rank) AS hits FROM p WHERE rank <= 20),
    c AS (SELECT r.query_id, rank, hits / CAST(size AS DOUBLE) AS recall, hits / CAST(rank AS DOUBLE) AS precision FROM r JOIN z ON z.query_id = r.query_id),
    d AS (SELECT query_id, (recall - coalesce(lag(recall) OVER w, 0)) * (coalesce(lag(precision) OVER w, 1) + precision) / 2 AS part FROM c WINDOW w AS (PARTITION BY query_id ORDER BY rank))
    SELECT query_id, round(sum(part), 6) AS ap FROM d GROUP BY query_id""")
def mean_ap(v):
    rows = v("embeddings")
    found = retrieval.similarities(rows.filter("vec_id % 100 = 0"), rows, 20)
    asked = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "label")
    truth = asked.join(rows.select("vec_id", "label"), "label").filter("query_id <> vec_id").select("query_id", "vec_id")
    return retrieval.average_precision(found, truth)


def _features(v):
    a = v("embeddings").filter("vec_id % 2 = 0").select(F.col("vec_id").alias("a"), F.col("embedding").alias("q"), (F.col("label") % 5).alias("k"))
    b = v("embeddings").filter("vec_id % 2 = 1").select(F.col("vec_id").alias("b"), F.col("embedding").alias("w"), (F.col("label") % 5).alias("k"))
    return a, b


def _feature_pairs(v):
    a, b = _features(v)
    return a.join(b, "k").select("a", "b", retrieval.dot(F.col("q"), F.col("w")).alias("score"))


_FEATURES = f"""--with
    p AS (SELECT a.vec_id AS a, b.vec_id AS b, {_PRODUCT} AS score FROM {{embeddings}} a JOIN {{embeddings}} b ON a.vec_id % 2 = 0 AND b.vec_id % 2 = 1 AND a.label % 5 = b.label % 5),
    l AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(score, 6) DESC, b) AS k FROM p), r AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY round(score, 6) DESC, a) AS k FROM p),
    lm AS (SELECT a, max(b) FILTER (WHERE k = 1) AS b, acos(max(score) FILTER (WHERE k = 1)) AS d1, coalesce(acos(max(score) FILTER (WHERE k = 2)), pi()) AS d2 FROM l WHERE k <= 2 GROUP BY a),
    rm AS (SELECT b, max(a) FILTER (WHERE k = 1) AS a, acos(max(score) FILTER (WHERE k = 1)) AS d1, coalesce(acos(max(score) FILTER (WHERE k = 2)), pi()) AS d2 FROM r WHERE k <= 2 GROUP BY b)
"""


@query(_FEATURES + "SELECT a, b, round(d1, 6) AS distance FROM lm WHERE d1 <= 1.3 AND d1 < 0.97 * d2")
def ratio_match(v):
    return retrieval.ratio_matches(_feature_pairs(v), 0.97, 1.3)


@query(_FEATURES + "SELECT lm.a, lm.b, round(lm.d1, 6) AS distance FROM lm JOIN rm ON lm.a = rm.a AND lm.b = rm.b WHERE lm.d1 <= 1.3 AND lm.d1 < 0.99 * lm.d2 AND rm.d1 <= 1.3 AND rm.d1 < 0.99 * rm.d2")
def mutual_match(v):
    return retrieval.mutual_matches_by_blocks(*_features(v), 0.99, 1.3)


@query("SELECT image_id, idx FROM (SELECT image_id, idx, row_number() OVER (PARTITION BY image_id ORDER BY x DESC, idx) AS k FROM {obs}) t WHERE k <= 2")
def top_scale(v):
    return retrieval.top_scale(v("obs").select("image_id", "idx", F.col("x").alias("scale")), 2).select("image_id", "idx")


# Stream-like queries over the events table (batch form of the same operators) --------------------------


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM {events} GROUP BY 1, 2")
def event_windows(v):
    from skein.streaming.ingest import windows

    return windows(v("events")).select("start", "event_type", "n", F.round("total", 2).alias("total"))


@query("""--with
    e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM {events}),
    g AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM e)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(v):
    from skein.streaming.ingest import sessions

    return sessions(v("events"))


@query("""--with
    p AS (SELECT DISTINCT image_id1, image_id2, shared FROM {covis}) SELECT image_id1, image_id2, shared FROM p WHERE image_id1 % 3 = 0 OR image_id2 % 3 = 0""")
def incremental_pairs(v):
    from skein.streaming.ingest import new_pairs

    obs = v("obs").select("image_id", "point_id")
    known, batch = obs.filter("image_id % 3 <> 0"), obs.filter("image_id % 3 = 0")
    done = v("sparse").select("image_id1", "image_id2").filter("image_id1 % 3 <> 0 AND image_id2 % 3 <> 0")
    return new_pairs(known, batch, done)


# Edits, sources, votes, rigs ---------------------------------------------------------------------------


@query("""--with
    m AS (SELECT image_id, idx, point_id, (image_id + idx) % 3 <> 0 AS stays, sum(CASE WHEN (image_id + idx) % 3 <> 0 THEN 1 ELSE 0 END) OVER (PARTITION BY point_id) AS n FROM {obs})
    SELECT image_id, idx, CASE WHEN stays AND n >= 2 THEN point_id END AS point_id FROM m""")
def observations_deleted(v):
    obs = v("obs").select("image_id", "idx", "point_id")
    return edits.delete_observations(obs, obs.filter("(image_id + idx) % 3 = 0"))


@query("SELECT image_id, idx, CASE WHEN point_id % 5 = 1 THEN point_id - 1 WHEN point_id % 5 > 2 THEN NULL ELSE point_id END AS point_id FROM {obs}")
def points_merged(v):
    obs = edits.delete_points(v("obs").select("image_id", "idx", "point_id"), v("points").filter("point_id % 5 > 2"))
    return edits.merge_points(obs, v("points").filter("point_id % 5 = 1").select((F.col("point_id") - 1).alias("id1"), F.col("point_id").alias("id2")))


@query("SELECT image_id1, image_id2, CAST(sum(CASE WHEN idx1 % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS inliers, CAST(sum(CASE WHEN idx1 % 2 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS outliers FROM {matches} GROUP BY image_id1, image_id2")
def match_split(v):
    good, bad = edits.split_by_mask(F.col("matches"), F.transform("matches", lambda m: m["idx1"] % 2 == 0))
    return _matches(v).select("image_id1", "image_id2", F.size(good).cast("long").alias("inliers"), F.size(bad).cast("long").alias("outliers"))


@query("""SELECT image_id, other, shared, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY shared DESC, other) AS rank
    FROM (SELECT image_id1 AS image_id, image_id2 AS other, shared FROM {sparse} UNION ALL SELECT image_id2, image_id1, shared FROM {sparse}) b WHERE image_id % 3 > 0 AND other % 3 > 0) t WHERE rank <= 2""")
def source_images(v):
    return views.source_images(v("sparse"), v("images").filter("image_id % 3 > 0"), most=2)


@query("""SELECT image_id1, image_id2 FROM (SELECT m.image_id1, m.image_id2, count(*) AS total, sum(CASE WHEN a.point_id % 7 = 0 THEN 1 ELSE 0 END) AS good FROM {matches} m JOIN {obs} a ON a.image_id = m.image_id1 AND a.idx = m.idx1 GROUP BY m.image_id1, m.image_id2) t
    WHERE good / CAST(total AS DOUBLE) < 0.2 AND image_id1 % 4 > 0 AND image_id2 % 4 > 0""")
def under_reconstructed(v):
    obs = v("obs").withColumn("point_id", F.when(F.col("point_id") % 7 == 0, F.col("point_id")))
    stats = model.pair_statistics(model.correspondences(v("matches")), obs).na.fill(0, ["triangulated"])
    return model.under_reconstructed(stats, v("images").filter("image_id % 4 > 0")).select("image_id1", "image_id2")


@query("SELECT DISTINCT m.idx1 AS idx, o.point_id FROM (SELECT * FROM {matches} UNION ALL SELECT image_id2, image_id1, idx2, idx1 FROM {matches}) m JOIN {obs} o ON o.image_id = m.image_id2 AND o.idx = m.idx2 WHERE m.image_id1 = (SELECT min(image_id1) FROM {matches})")
def registration_candidates(v):
    corr = cut(model.correspondences(v("matches")))
    return model.registration_candidates(corr, v("obs"), corr.agg(F.min("image_id")).first()[0])


_VOTES = """--with
    t AS (SELECT l_suppkey % 20 AS pair, l_quantity * 160 - 4080 AS tx, (l_orderkey % 50) * 160 - 4000 AS ty, pow(2, (l_partkey % 7 - 3) / 1.5) AS scale, (l_linenumber % 8) * 0.75 - 2.9 AS angle FROM {lineitem}),
    b AS (SELECT pair, least(CAST(trunc((tx + 4096) / 8192 * 64) AS INTEGER), 63) AS x, least(CAST(trunc((ty + 4096) / 8192 * 64) AS INTEGER), 63) AS y, least(CAST(trunc((log2(scale) + log2(10)) / (2 * log2(10)) * 32) AS INTEGER), 31) AS s, least(CAST(trunc((angle + pi()) / (2 * pi()) * 8) AS INTEGER), 7) AS a
          FROM t WHERE abs(tx) <= 4096 AND abs(ty) <= 4096 AND abs(log2(scale)) <= log2(10)),
    f AS (SELECT pair, x, y, s, a, count(*) AS n FROM b GROUP BY ALL),
    l AS (SELECT unnest([1, 2, 3, 4, 5]) AS level),
    c AS (SELECT pair, level, x >> level AS px, y >> level AS py, s >> level AS ps, a >> level AS pa, sum(n) AS m FROM f, l GROUP BY ALL)
    SELECT f.pair, x, y, s, a, n AS votes, round(n + sum(m * pow(0.5, l.level)), 4) AS score FROM f CROSS JOIN l JOIN c ON c.pair = f.pair AND c.level = l.level AND px = x >> l.level AND py = y >> l.level AND ps = s >> l.level AND pa = a >> l.level WHERE n >= 2 GROUP BY f.pair, x, y, s, a, n"""


@query(_VOTES)
def transform_votes(v):
    k = F.col
    rows = v("lineitem").select((k("l_suppkey") % 20).alias("pair"), (k("l_quantity") * 160 - 4080).alias("tx"), ((k("l_orderkey") % 50) * 160 - 4000).cast("double").alias("ty"), F.pow(F.lit(2.0), (k("l_partkey") % 7 - 3) / 1.5).alias("scale"), ((k("l_linenumber") % 8) * 0.75 - 2.9).alias("angle"))
    return views.votes(rows, ["pair"], least=2).withColumn("score", F.round("score", 4))


@query("""SELECT l_partkey % 500 AS cluster, count(*) AS n, round(median(l_quantity), 4) AS x, round(median(l_extendedprice), 4) AS y, round(median(l_discount), 4) AS z FROM {lineitem} GROUP BY 1 HAVING count(*) >= 5""")
def fused_points(v):
    c = F.col
    rows = v("lineitem").select((c("l_partkey") % 500).alias("cluster"), c("l_quantity").alias("x"), c("l_extendedprice").alias("y"), c("l_discount").alias("z"), *[F.lit(0.0).alias(n) for n in ("nx", "ny", "nz", "r", "g", "b")])
    return views.fused_points(rows).select("cluster", "n", *[F.round(n, 4).alias(n) for n in "xyz"])


@query("""--with
    i AS (SELECT o_orderkey // 4 AS snapshot, o_orderkey % 4 AS c, o_orderkey % 4 + (o_orderkey // 4) % 3 AS x, CAST(o_orderkey % 4 * 2 AS DOUBLE) AS y, CAST((o_orderkey // 4) % 5 AS DOUBLE) AS z FROM {orders}),
    r AS (SELECT a.snapshot, sqrt(3.0 * 3.0 * (a.c - b.c) * (a.c - b.c)) / sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)) AS ratio FROM i a JOIN i b ON a.snapshot = b.snapshot AND a.c < b.c)
    SELECT round(avg(ratio), 6) AS scale FROM r""")
def rig_scale(v):
    k, snap = F.col("o_orderkey"), F.floor(F.col("o_orderkey") / 4)
    images = v("orders").select(snap.alias("snapshot"), (k % 4).alias("camera_id"), (k % 4 + snap % 3).cast("double").alias("x"), (k % 4 * 2).cast("double").alias("y"), (snap % 5).cast("double").alias("z"))
    rig = v("orders").select((k % 4).alias("camera_id")).distinct().select("camera_id", (F.col("camera_id") * 3.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    return views.rig_scale(rig, images).select(F.round("scale", 6).alias("scale"))


def flagship(spark, sf_dir: str) -> DataFrame:
    """Co-visibility, largest component, and the best neighbours in it."""
    v = lambda name: frame(spark, sf_dir, name)
    edges = model.shared_points(v("obs")).filter("shared >= 2").select(F.col("image_id1").alias("src"), F.col("image_id2").alias("dst"), F.col("shared").alias("weight"))
    inside = graph.largest_subgraph(cut(edges))
    return model.top_overlap(inside.select(F.col("src").alias("image_id1"), F.col("dst").alias("image_id2"), F.col("weight").alias("shared")))


# The other catalogues register their queries as they are loaded.
from . import catalog_graph, catalog_model, catalog_numeric, catalog_retrieval, catalog_sources, catalog_store  # noqa: E402, F401
