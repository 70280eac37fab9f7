"""Queries that run through a store: a scene is written to it, edited and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import pairs, retrieval, store
from skein.operators.store import SCHEMAS, Store
from skein.plans import flow
from skein.session import cut, scratch

from .registry import query


def _store(v) -> Store:
    spark = v("images").sparkSession
    return Store(spark, scratch(spark, "store")).create()


def _images(v):
    return v("images").select("image_id", "name", "camera_id")


def _cameras(v):
    return v("cameras").select("camera_id", "model", "width", "height", F.array("f", "cx", "cy", "k1").alias("params"), F.col("prior_focal").alias("prior_focal_length"))


def matches_of(v):
    """Match lists of the sparse pairs, with a configuration each."""
    listed = F.sort_array(F.collect_list(F.struct(F.col("idx1").cast("int").alias("idx1"), F.col("idx2").cast("int").alias("idx2"))))  # a pair's matches
    rows = v("matches").groupBy("image_id1", "image_id2").agg(listed.alias("matches"))
    return rows.withColumn("pair_id", pairs.pair_id(F.col("image_id1"), F.col("image_id2"))).withColumn("config", (F.col("pair_id") % 8).cast("int"))


@query("SELECT * FROM (VALUES ('cameras', 6), ('images', 5), ('keypoints', 8), ('descriptors', 3), ('matches', 4), ('two_view_geometries', 7)) t(name, columns), (SELECT CAST(0 AS BIGINT) AS rows) r")
def store_created(v):
    made = _store(v)
    return made.spark.createDataFrame([(t, len(made.read(t).columns), made.read(t).count()) for t in SCHEMAS], "name string, columns int, rows bigint")


@query("SELECT i.image_id, i.name, c.camera_id, c.model, c.width, c.f FROM {images} i JOIN {cameras} c ON i.camera_id = c.camera_id")
def store_scans(v):
    made = _store(v)
    made.append("cameras", _cameras(v))
    made.append("images", _images(v))
    return made.read("images").join(made.read("cameras"), "camera_id").select("image_id", "name", "camera_id", "model", "width", F.col("params")[0].alias("f"))


@query("SELECT image_id, name, camera_id FROM {images} WHERE name = '0000000042' OR image_id = 7")
def image_lookup(v):
    made = _store(v)
    made.append("images", _images(v))
    rows = made.read("images")
    return rows.filter((F.col("name") == "0000000042") | (F.col("image_id") == 7)).select("image_id", "name", "camera_id")


@query("""SELECT image_id, name FROM {images} WHERE image_id % 5 = 0 UNION ALL
    SELECT (SELECT max(image_id) FROM {images} WHERE image_id % 5 = 0) + row_number() OVER (ORDER BY reverse(name)), reverse(name) FROM {images} WHERE image_id % 5 > 0""")
def rows_inserted(v):
    made = _store(v)
    made.append("images", _images(v).filter("image_id % 5 = 0"))
    made.insert("images", _images(v).filter("image_id % 5 > 0").withColumn("name", F.reverse("name")), "image_id", ["name"])
    return made.read("images").select("image_id", "name")


@query("SELECT image_id, CASE WHEN image_id % 9 = 0 THEN camera_id + 1 ELSE camera_id END AS camera_id FROM {images}")
def images_updated(v):
    made = _store(v)
    made.append("images", _images(v))
    changed = _images(v).filter("image_id % 9 = 0").withColumn("camera_id", F.col("camera_id") + 1)
    unknown = changed.limit(1).withColumn("image_id", F.lit(-5).cast("long"))
    made.update("images", changed.unionByName(unknown), "image_id")
    return made.read("images").select("image_id", "camera_id")


@query("SELECT image_id, name FROM {images} WHERE image_id % 7 <> 0 AND name <> '0000000011'")
def images_deleted(v):
    made = _store(v)
    made.append("images", _images(v))
    made.delete("images", _images(v).filter("image_id % 7 = 0"), "image_id")
    made.delete("images", _images(v).filter("name = '0000000011'"), "name")
    return made.read("images").select("image_id", "name")


@query("SELECT * FROM (VALUES (1, CAST(0 AS BIGINT))) t(version, rows) UNION ALL SELECT 2, count(*) FROM {images} WHERE image_id % 2 = 0 UNION ALL SELECT 3, count(*) FROM {images} UNION ALL SELECT 4, CAST(0 AS BIGINT)")
def store_versions(v):
    made = _store(v)
    made.append("images", _images(v).filter("image_id % 2 = 0"))
    made.append("images", _images(v).filter("image_id % 2 > 0"))
    made.clear("images")
    rows = [(k, made.read("images", k).count()) for k in made._versions("images")]
    made.vacuum("images")
    assert len(made._versions("images")) == 1
    return made.spark.createDataFrame(rows, "version int, rows bigint")


@query("SELECT image_id, name, camera_id, true AS no_prior FROM {images}")
def rows_migrated(v):
    """Rows of an older schema: other types, columns that are not there."""
    old = _images(v).select(F.col("image_id").cast("int").alias("image_id"), "name", F.col("camera_id").cast("string").alias("camera_id"))
    rows = store.migrated(old, SCHEMAS["images"])
    return rows.select("image_id", "name", "camera_id", (F.col("prior_q").isNull() & F.col("prior_t").isNull()).alias("no_prior"))


@query("SELECT c_custkey AS image_id, c_custkey IN (SELECT image_id FROM {obs}) AS found FROM {customer}")
def keys_existing(v):
    return store.existing(v("customer").select(F.col("c_custkey").alias("image_id")), v("obs"), "image_id")


@query("SELECT image_id1, image_id2, count(*) AS rows FROM {matches} WHERE image_id1 % 3 > 0 GROUP BY image_id1, image_id2")
def match_scan(v):
    rows = matches_of(v).withColumn("matches", F.when(F.col("image_id1") % 3 > 0, F.col("matches")).otherwise(F.slice("matches", 1, 0)))
    return store.matched_pairs(rows).select("image_id1", "image_id2", F.size("matches").cast("long").alias("rows"))


@query("SELECT (SELECT count(*) FROM {obs}) AS keypoints, (SELECT count(*) FROM {matches}) AS matches, (SELECT max(n) FROM (SELECT count(*) AS n FROM {matches} GROUP BY image_id1, image_id2)) AS most_matches, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM {matches} GROUP BY image_id1, image_id2 HAVING count(*) >= 3)) AS inliers")
def store_sums(v):
    counts = cut(store.inlier_counts(matches_of(v)))
    own = counts.agg(F.sum("inliers").alias("matches"), F.max("inliers").alias("most_matches"), F.coalesce(F.sum(F.when(F.col("inliers") >= 3, F.col("inliers"))), F.lit(0)).alias("inliers"))
    return v("obs").agg(F.count("*").alias("keypoints")).crossJoin(own)  # one row each


@query("""SELECT a.image_id AS image_id1, a.image_id + 1 AS image_id2, round(cos(half_yaw), 6) AS qw, round(CASE WHEN a.image_id % 2 = 0 THEN -sin(half_yaw) ELSE sin(half_yaw) END, 6) AS qz,
    round(CASE WHEN a.image_id % 2 = 0 THEN -(cos(2 * half_yaw) * tx + sin(2 * half_yaw) * ty) ELSE tx END, 6) AS tx, round(CASE WHEN a.image_id % 2 = 0 THEN -(cos(2 * half_yaw) * ty - sin(2 * half_yaw) * tx) ELSE ty END, 6) AS ty,
    round(CASE WHEN a.image_id % 2 = 0 THEN -tz ELSE tz END, 6) AS tz, CASE WHEN a.image_id % 2 = 0 THEN 9 ELSE 4 END AS idx1, CASE WHEN a.image_id % 2 = 0 THEN 4 ELSE 9 END AS idx2 FROM {images} a""")
def geometries_swapped(v):
    one = F.array(F.struct(F.lit(4).alias("idx1"), F.lit(9).alias("idx2")))
    rows = v("images").select(pairs.pair_id(F.col("image_id"), F.col("image_id") + 1).alias("pair_id"), "image_id", one.alias("matches"), F.lit(2).alias("config"), F.array(F.cos("half_yaw"), F.lit(0.0), F.lit(0.0), F.sin("half_yaw")).alias("qvec"), F.array("tx", "ty", "tz").alias("tvec"))
    even = F.col("image_id") % 2 == 0
    asked = rows.select(F.when(even, F.col("image_id") + 1).otherwise(F.col("image_id")).alias("image_id1"), F.when(even, F.col("image_id")).otherwise(F.col("image_id") + 1).alias("image_id2"))
    found = store.geometries_from(rows, asked)
    return found.select(
        F.least("image_id1", "image_id2").alias("image_id1"), F.greatest("image_id1", "image_id2").alias("image_id2"), F.round(F.col("qvec")[0], 6).alias("qw"), F.round(F.col("qvec")[3], 6).alias("qz"),
        *[F.round(F.col("tvec")[i], 6).alias(n) for i, n in enumerate(("tx", "ty", "tz"))], F.col("matches")[0]["idx1"].alias("idx1"), F.col("matches")[0]["idx2"].alias("idx2"),
    )


_PARTS = "p AS (SELECT unnest([0, 1]) AS part, image_id, name, camera_id FROM {images}), q AS (SELECT * FROM p WHERE (image_id + part) % 3 > 0), r AS (SELECT *, dense_rank() OVER (ORDER BY name) AS gid, row_number() OVER (PARTITION BY name ORDER BY part, image_id) AS k FROM q)"


def _parts(v):
    sparse = v("sparse").select("image_id1", "image_id2")
    out = {}
    for part in (0, 1):
        images = _images(v).filter(f"(image_id + {part}) % 3 > 0")
        inside = store.induced(sparse, images).withColumn("pair_id", pairs.pair_id(F.col("image_id1"), F.col("image_id2")))
        # The ids of a part are its own.
        moved = lambda c, part=part: (F.col(c) + part * 1_000_000).alias(c)
        one = F.array(F.struct(F.lit(part).alias("idx1"), F.lit(7).alias("idx2"))).alias("matches")
        out[part] = {"cameras": _cameras(v), "images": images.select(moved("image_id"), "name", "camera_id"), "matches": inside.select("pair_id", moved("image_id1"), moved("image_id2"), one)}
    return out


@query("--with\n" + _PARTS + " SELECT gid AS image_id, name, camera_id * 2 + part AS camera_id FROM r WHERE k = 1")
def stores_exported(v):
    made = _store(v)
    store.export(_parts(v), made)
    return made.read("images").select("image_id", "name", "camera_id")


@query("--with\n" + _PARTS + """, g AS (SELECT DISTINCT image_id, gid FROM r), m AS (SELECT part, image_id1, image_id2 FROM {sparse}, (SELECT unnest([0, 1]) AS part) x WHERE (image_id1 + part) % 3 > 0 AND (image_id2 + part) % 3 > 0)
    SELECT least(a.gid, b.gid) AS image_id1, greatest(a.gid, b.gid) AS image_id2, CAST(min(part) AS INTEGER) AS idx1 FROM m JOIN g a ON a.image_id = m.image_id1 JOIN g b ON b.image_id = m.image_id2 GROUP BY 1, 2""")
def matches_exported(v):
    made = _store(v)
    store.export(_parts(v), made)
    return made.read("matches").select("image_id1", "image_id2", F.col("matches")[0]["idx1"].alias("idx1"))


@query("SELECT m.image_id1, m.image_id2, m.idx1, m.idx2, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM {matches} m JOIN {obs} a ON a.image_id = m.image_id1 AND a.idx = m.idx1 JOIN {obs} b ON b.image_id = m.image_id2 AND b.idx = m.idx2")
def matched_points(v):
    return flow.matched_points(v("matches"), v("obs")).select("image_id1", "image_id2", "idx1", "idx2", "x1", "y1", "x2", "y2")


@query("SELECT image_id1, image_id2, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS inliers FROM {matches} GROUP BY image_id1, image_id2")
def enough_inliers(v):
    rows = flow.enough(matches_of(v).withColumnRenamed("matches", "inliers"), 3)
    return rows.select("image_id1", "image_id2", F.size("inliers").cast("long").alias("inliers"))


@query("SELECT id1, id2, count(*) AS shared FROM (SELECT image_id, idx, point_id AS id1 FROM {obs} WHERE image_id % 3 > 0) a JOIN (SELECT image_id, idx, CASE WHEN idx % 2 = 0 THEN point_id ELSE point_id + 7 END AS id2 FROM {obs} WHERE image_id % 2 = 0) b USING (image_id, idx) GROUP BY id1, id2")
def common_points(v):
    obs = v("obs").select("image_id", "idx", "point_id")
    other = obs.filter("image_id % 2 = 0").withColumn("point_id", F.when(F.col("idx") % 2 == 0, F.col("point_id")).otherwise(F.col("point_id") + 7))
    return store.common_points(obs.filter("image_id % 3 > 0"), other)


_MODELS = "m AS (SELECT image_id % 4 AS model, image_id, idx FROM {obs} UNION SELECT image_id % 7, image_id, idx FROM {obs})"


@query("--with\n" + _MODELS + " SELECT a.model AS m1, b.model AS m2, count(DISTINCT a.image_id) AS images, count(*) AS observations FROM m a JOIN m b ON a.image_id = b.image_id AND a.idx = b.idx AND a.model < b.model GROUP BY 1, 2")
def model_pairs(v):
    obs = v("obs")
    rows = obs.select((F.col("image_id") % 4).alias("model"), "image_id", "idx").unionByName(obs.select((F.col("image_id") % 7).alias("model"), "image_id", "idx")).distinct()
    return store.model_pairs(rows)


_PLAN = """--with
    a AS (SELECT image_id, idx, point_id // 2 AS point_id FROM {obs} WHERE image_id % 4 = 0 AND point_id % 3 > 0),
    b AS (SELECT image_id, idx, CASE WHEN point_id % 5 = 0 THEN point_id // 8 ELSE 1000000 + point_id END AS point_id FROM {obs} WHERE image_id % 12 = 0 OR image_id % 4 = 1),
    p AS (SELECT b.point_id, CASE WHEN count(a.point_id) = 0 THEN 'copy' WHEN count(DISTINCT a.point_id) = 1 THEN 'merge' ELSE 'conflict' END AS action,
          CASE WHEN count(DISTINCT a.point_id) = 1 THEN min(a.point_id) END AS old_id, count(*) AS elements, count(a.point_id) AS known FROM b LEFT JOIN a USING (image_id, idx) GROUP BY b.point_id)
"""


def _two_models(v):
    obs = v("obs").select("image_id", "idx", "point_id")
    a = obs.filter("image_id % 4 = 0 AND point_id % 3 > 0").withColumn("point_id", F.floor(F.col("point_id") / 2))
    point = F.when(F.col("point_id") % 5 == 0, F.floor(F.col("point_id") / 8)).otherwise(1_000_000 + F.col("point_id"))
    return a, obs.filter("image_id % 12 = 0 OR image_id % 4 = 1").withColumn("point_id", point)


@query(_PLAN + "SELECT * FROM p")
def merge_plan(v):
    return flow.merge_plan(*_two_models(v))


@query(_PLAN + """SELECT image_id, idx, point_id FROM a UNION ALL
    SELECT b.image_id, b.idx, CASE WHEN action = 'merge' THEN old_id ELSE b.point_id + (SELECT max(point_id) FROM a) + 1 END FROM b JOIN p USING (point_id) LEFT JOIN a ON a.image_id = b.image_id AND a.idx = b.idx WHERE action <> 'conflict' AND a.image_id IS NULL""")
def merged_observations(v):
    return flow.merged_observations(*_two_models(v))


@query("SELECT doc_id, word, tf FROM {words}")
def index_roundtrip(v):
    """A visual index written and read back."""
    spark = v("words").sparkSession
    path = scratch(spark, "index")
    retrieval.write_index(path, postings=v("words"))
    return retrieval.read_index(spark, path)["postings"].select("doc_id", "word", "tf")


@query("SELECT 'point' AS kind, point_id AS id, px AS x FROM {points}")
def snapshots(v):
    """A repeated snapshot replaces the first."""
    spark = v("points").sparkSession
    path = scratch(spark, "snapshots")
    rows = v("points").select(F.lit(0).cast("long").alias("label"), F.lit("point").alias("kind"), F.col("point_id").alias("id"), F.array("px", "py", "pz").alias("v"))
    flow.snapshot(rows.limit(3), path, 5)
    return spark.read.parquet(flow.snapshot(rows, path, 5)).select("kind", "id", F.col("v")[0].alias("x"))
