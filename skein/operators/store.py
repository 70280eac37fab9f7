"""The relational store: versioned tables, merges, look-ups and edits.

Every edit is a new version of a table; readers take the newest one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from skein.functions import geometry as g

from skein.session import cut

from .pairs import numbered, pair_id

SCHEMAS: dict[str, str] = {
    "cameras": "camera_id bigint, model int, width int, height int, params array<double>, prior_focal_length boolean",
    "images": "image_id bigint, name string, camera_id bigint, prior_q array<double>, prior_t array<double>",
    "keypoints": "image_id bigint, point2d_idx int, x float, y float, a11 float, a12 float, a21 float, a22 float",
    "descriptors": "image_id bigint, point2d_idx int, descriptor array<smallint>",
    "matches": "pair_id bigint, image_id1 bigint, image_id2 bigint, matches array<struct<idx1:int,idx2:int>>",
    "two_view_geometries": "pair_id bigint, image_id1 bigint, image_id2 bigint, matches array<struct<idx1:int,idx2:int>>, config int, qvec array<double>, tvec array<double>",
}

#: Two-view configurations, by number (fixed values).
CONFIGS = ("UNDEFINED", "DEGENERATE", "CALIBRATED", "UNCALIBRATED", "PLANAR", "PANORAMIC", "PLANAR_OR_PANORAMIC", "WATERMARK", "MULTIPLE")
WATERMARK = 7


class Store:
    """The six tables below one path (any file system Spark can write).

    A table's rows lie in data folders; a version is a manifest, a small file that
    names the folders it consists of. An append writes its own rows only, an edit all
    rows anew; either ends by creating the next manifest, so a failed one leaves no
    trace that readers see. One writer at a time; ``vacuum`` removes old versions.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = hadoop.Path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, table: str) -> list[str]:
        at = self._path(f"{self.path}/{table}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def _versions(self, table: str) -> list[int]:
        return sorted(int(n[1:]) for n in self._names(table) if n[:1] == "v" and n[1:].isdigit())

    def _folders(self, table: str, version: int) -> list[str]:
        stream = self._fs.open(self._path(f"{self.path}/{table}/v{version}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text.split()

    def _publish(self, table: str, folders: list[str]) -> None:
        version = (self._versions(table) or [0])[-1] + 1
        made = self._path(f"{self.path}/{table}/.v{version}")
        stream = self._fs.create(made, True)
        stream.write(bytearray("\n".join(folders).encode()))
        stream.close()
        if not self._fs.rename(made, self._path(f"{self.path}/{table}/v{version}")):
            raise OSError(f"version {version} of {table} is there already")

    def _write(self, table: str, rows: DataFrame) -> str:
        name = f"d{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{table}/{name}")
        return name

    def create(self) -> Store:
        """Create missing tables, empty."""
        for table, schema in SCHEMAS.items():
            if not self._versions(table):
                self.replace(table, self.spark.createDataFrame([], schema))
        return self

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """The newest version (or a given one); columns that older rows lack are null."""
        versions = self._versions(table)
        if not versions:
            return self.spark.createDataFrame([], SCHEMAS[table])
        folders = self._folders(table, versions[-1] if version is None else version)
        return migrated(self.spark.read.option("mergeSchema", True).parquet(*[f"{self.path}/{table}/{f}" for f in folders]), SCHEMAS[table])

    def replace(self, table: str, rows: DataFrame) -> None:
        """Write a new version of a table."""
        self._publish(table, [self._write(table, rows)])

    def append(self, table: str, rows: DataFrame) -> None:
        """Add rows; those that are there are not written again."""
        versions = self._versions(table)
        before = self._folders(table, versions[-1]) if versions else []
        self._publish(table, [*before, self._write(table, migrated(rows, SCHEMAS[table]))])

    def insert(self, table: str, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
        """Append rows with new ids: the largest one so far plus 1, 2, ... in order."""
        largest = self.read(table).agg(F.max(key)).first()[0] or 0
        rows = numbered(rows.drop(key), order).withColumn(key, F.col("position") + largest + 1).drop("position")
        self.append(table, rows)
        return rows

    def update(self, table: str, rows: DataFrame, key: str) -> None:
        """Replace the rows whose key occurs in ``rows``; other keys are ignored."""
        now = self.read(table)
        known = migrated(rows, SCHEMAS[table]).join(now.select(key), key, "left_semi").select(*now.columns)
        self.replace(table, now.join(rows.select(key), key, "left_anti").unionByName(known))

    def delete(self, table: str, keys: DataFrame, key: str) -> None:
        self.replace(table, self.read(table).join(keys.select(key).distinct(), key, "left_anti"))

    def clear(self, table: str) -> None:
        self.replace(table, self.read(table).limit(0))

    def exists(self, table: str, condition: Column) -> bool:
        return not self.read(table).filter(condition).isEmpty()

    def vacuum(self, table: str, keep: int = 1) -> None:
        """Remove all but the newest ``keep`` versions and the rows only they had."""
        versions = self._versions(table)
        used = {f for v in versions[-keep:] for f in self._folders(table, v)}
        for name in self._names(table):
            old = name[:1] == "v" and name[1:].isdigit() and int(name[1:]) not in versions[-keep:]
            if old or (name[:1] == "d" and name not in used):
                self._fs.delete(self._path(f"{self.path}/{table}/{name}"), True)


def migrated(rows: DataFrame, schema: str) -> DataFrame:
    """Rows under a schema: missing columns become null, others are cast."""
    fields = T._parse_datatype_string(schema).fields
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])


# Look-ups -----------------------------------------------------------------------


def swap_matches(matches: Column) -> Column:
    """A match list seen from the other image."""
    return F.transform(matches, lambda m: F.struct(m["idx2"].alias("idx1"), m["idx1"].alias("idx2")))


def matches_between(matches: DataFrame, a: int, b: int) -> DataFrame:
    """(idx1, idx2) rows of a pair in the order asked for."""
    pair = matches.filter(F.col("pair_id") == pair_id(F.lit(a), F.lit(b)))
    listed = swap_matches(F.col("matches")) if a > b else F.col("matches")
    return pair.select(F.explode(listed).alias("m")).select("m.idx1", "m.idx2")


def existing(keys: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Whether each key occurs: (key, found)."""
    known = rows.select(key).distinct().withColumn("found", F.lit(True))
    return keys.select(key).join(known, key, "left").select(key, F.coalesce("found", F.lit(False)).alias("found"))


def matched_pairs(matches: DataFrame) -> DataFrame:
    """Pairs that have at least one match."""
    return matches.filter(F.size("matches") > 0)


def geometries_from(geometries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Two-view geometries as seen from the pairs (image_id1, image_id2) asked for.

    A pair asked for the other way round has its matches swapped and its relative pose
    (qvec, tvec) inverted.
    """
    asked = pairs.select("image_id1", "image_id2", pair_id(F.col("image_id1"), F.col("image_id2")).alias("pair_id"), (F.col("image_id1") > F.col("image_id2")).alias("_turned"))
    rows = asked.join(geometries.select("pair_id", "matches", "config", "qvec", "tvec"), "pair_id")
    q, t = tuple(F.col("qvec")[i] for i in range(4)), tuple(F.col("tvec")[i] for i in range(3))
    back_q, back_t = g.invert_pose(q, t)
    turned = lambda back, c: F.when(F.col("_turned") & F.col(c).isNotNull(), back).otherwise(F.col(c)).alias(c)
    return rows.select("pair_id", "image_id1", "image_id2", turned(swap_matches(F.col("matches")), "matches"), "config", turned(F.array(*back_q), "qvec"), turned(F.array(*back_t), "tvec"))


def common_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """Points of two models that share an observation (image_id, idx): (id1, id2, shared)."""
    left, right = a.select("image_id", "idx", F.col("point_id").alias("id1")), b.select("image_id", "idx", F.col("point_id").alias("id2"))
    both = left.filter("id1 IS NOT NULL").join(right.filter("id2 IS NOT NULL"), ["image_id", "idx"])
    return both.groupBy("id1", "id2").agg(F.count("*").alias("shared"))


def model_pairs(models: DataFrame) -> DataFrame:
    """Partial models that share observations: (m1 < m2, images, observations), from
    rows (model, image_id, idx)."""
    left, right = models.select(F.col("model").alias("m1"), "image_id", "idx"), models.select(F.col("model").alias("m2"), "image_id", "idx")
    both = left.join(right, ["image_id", "idx"]).filter("m1 < m2")
    return both.groupBy("m1", "m2").agg(F.countDistinct("image_id").alias("images"), F.count("*").alias("observations"))


def export(parts: dict[int, dict[str, DataFrame]], store: Store) -> None:
    """Merge partial stores by image name and write them as one.

    The first part that holds a name gives the image's rows; ids are the global ones of
    ``merge_by_name``, cameras are told apart by part.
    """
    images = None
    for part, tables in sorted(parts.items()):
        rows = tables["images"].withColumn("part", F.lit(part))
        images = rows if images is None else images.unionByName(rows)
    ids = cut(merge_by_name(images.select("part", "image_id", "name")))
    n = max(parts) + 1
    camera = lambda c: F.col(c) * n + F.col("part")
    named = images.join(ids, ["part", "image_id", "name"]).filter("wins").withColumn("camera_id", camera("camera_id")).withColumn("image_id", F.col("global_id"))
    store.replace("images", migrated(named, SCHEMAS["images"]))
    for table in (t for t in SCHEMAS if t != "images"):
        out = None
        for part, tables in sorted(parts.items()):
            if table not in tables:
                continue
            rows, own = tables[table].withColumn("part", F.lit(part)), ids.filter(F.col("part") == part)
            if table == "cameras":
                rows = rows.withColumn("camera_id", camera("camera_id"))
            elif "pair_id" in rows.columns:
                for k in ("image_id1", "image_id2"):
                    rows = remap(rows, own.select(F.col("image_id").alias("old"), F.col("global_id").alias("new")), k)
                turned = F.col("image_id1") > F.col("image_id2")
                rows = rows.withColumn("matches", F.when(turned, swap_matches(F.col("matches"))).otherwise(F.col("matches")))
                low, high = F.least("image_id1", "image_id2"), F.greatest("image_id1", "image_id2")
                rows = rows.withColumns({"image_id1": low, "image_id2": high, "pair_id": pair_id(low, high)})
            else:  # features come from the part whose image wins
                rows = remap(rows, own.filter("wins").select(F.col("image_id").alias("old"), F.col("global_id").alias("new")), "image_id")
            out = rows if out is None else out.unionByName(rows)
        if out is not None:
            # Of a pair that several parts hold the first one's row stays.
            out = out.withColumn("_r", F.row_number().over(Window.partitionBy("pair_id").orderBy("part"))).filter("_r = 1") if "pair_id" in out.columns else out
            store.replace(table, migrated(out, SCHEMAS[table]))


def inlier_counts(geometries: DataFrame) -> DataFrame:
    """(pair_id, inliers); only the lists' sizes are read on."""
    return geometries.select("pair_id", F.size("matches").cast("long").alias("inliers"))


def usable(inliers: Column, config: Column, *, least: int = 15, ignore_watermarks: bool = False) -> Column:
    """Whether a geometry is an edge."""
    return (inliers >= least) & ((config != WATERMARK) if ignore_watermarks else F.lit(True))


def connected_images(images: DataFrame, edges: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Images (optionally of a list of names) with an edge inside the selection."""
    chosen = images if names is None else images.join(names.select("name"), "name", "left_semi")
    inside = induced(edges, chosen)
    ends = inside.select(F.col("image_id1").alias("image_id")).unionByName(inside.select(F.col("image_id2").alias("image_id"))).distinct()
    return chosen.join(ends, "image_id", "left_semi")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (column image_id)."""
    ids = nodes.select("image_id")
    return edges.join(ids, edges["image_id1"] == ids["image_id"], "left_semi").join(ids, edges["image_id2"] == ids["image_id"], "left_semi")


# Merges ---------------------------------------------------------------------------


def merge(first: dict[str, DataFrame], second: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Two stores as one: the second's ids move behind the first's.

    A name that both hold is an error.
    """
    common = first["images"].join(second["images"], "name", "left_semi").limit(1)
    if not common.isEmpty():
        raise ValueError(f"both stores hold the image {common.first()['name']!r}")
    shift = {k: (first[t].agg(F.max(k)).first()[0] or 0) + 1 - (second[t].agg(F.min(k)).first()[0] or 0) for t, k in (("cameras", "camera_id"), ("images", "image_id"))}
    out = {}
    for table, rows in second.items():
        for key, by in (("camera_id", "camera_id"), ("image_id", "image_id"), ("image_id1", "image_id"), ("image_id2", "image_id")):
            if key in rows.columns:
                rows = rows.withColumn(key, F.col(key) + shift[by])
        if "pair_id" in rows.columns:
            rows = rows.withColumn("pair_id", pair_id(F.col("image_id1"), F.col("image_id2")))
        out[table] = first[table].unionByName(rows, allowMissingColumns=True)
    return out


def merge_by_name(parts: DataFrame) -> DataFrame:
    """(part, image_id, name) of partial stores -> global ids by name.

    An image known to several parts is one; the smallest part's entry wins.
    Returns (part, image_id, name, global_id, wins).
    """
    own = Window.partitionBy("name").orderBy("part", "image_id")
    ranked = parts.withColumn("wins", F.row_number().over(own) == 1)
    ids = numbered(ranked.filter("wins").select("name"), ["name"], "global_id").withColumn("global_id", F.col("global_id") + 1)
    return ranked.join(ids, "name").select("part", "image_id", "name", "global_id", "wins")


def remap(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``column`` translated by (old, new); rows without a translation go."""
    return rows.join(ids.select(F.col("old").alias(column), F.col("new").alias("_new")), column).drop(column).withColumnRenamed("_new", column)


def common_and_missing(a: DataFrame, b: DataFrame, key: str = "image_id") -> tuple[DataFrame, DataFrame]:
    """Keys of ``b`` that ``a`` has too, and those it lacks."""
    own, other = a.select(key).distinct(), b.select(key).distinct()
    return other.intersect(own), other.exceptAll(own)
