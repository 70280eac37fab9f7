"""Sparse models as text and binary files, and exports to other formats.

A model is three tables: ``cameras`` (camera_id, model, width, height, params),
``images`` (image_id, qvec, tvec, camera_id, name, cluster_id, points array of
(x, y, point3d_id)) and ``points`` (point3d_id, x, y, z, r, g, b, error, track
array of (image_id, idx)).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.kernels.robust import rq

CAMERAS = "camera_id bigint, model int, width bigint, height bigint, params array<double>"
IMAGES = "image_id bigint, qvec array<double>, tvec array<double>, camera_id bigint, name string, cluster_id bigint, points array<struct<x:double,y:double,point3d_id:bigint>>"
POINTS = "point3d_id bigint, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:bigint,idx:bigint>>"

#: Parameters of each camera model, by number (fixed values).
N_PARAMS = {0: 3, 1: 4, 2: 4, 3: 5, 4: 8, 5: 8, 6: 12, 7: 5, 8: 4, 9: 5, 10: 12}
NAMES = ("SIMPLE_PINHOLE", "PINHOLE", "SIMPLE_RADIAL", "RADIAL", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "FOV", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE", "THIN_PRISM_FISHEYE")
NO_POINT = (1 << 64) - 1


# Text -----------------------------------------------------------------------------


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.text(path)
    return text.filter((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#"))).select(F.split(F.trim("value"), r"\s+").alias("w"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.col("w")
    number = F.create_map(*[F.lit(x) for i, n in enumerate(NAMES) for x in (n, i)])
    return _lines(spark, path).select(w[0].cast("long").alias("camera_id"), number[w[1]].cast("int").alias("model"), w[2].cast("long").alias("width"), w[3].cast("long").alias("height"), F.transform(F.slice(w, 5, 100), lambda x: x.cast("double")).alias("params"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.col("w")
    n = ((F.size(w) - 8) / 2).cast("int")
    track = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.element_at(w, 9 + 2 * i).cast("long").alias("image_id"), F.element_at(w, 10 + 2 * i).cast("long").alias("idx")))
    return _lines(spark, path).select(
        w[0].cast("long").alias("point3d_id"), *[w[i].cast("double").alias(c) for i, c in ((1, "x"), (2, "y"), (3, "z"))], *[w[i].cast("int").alias(c) for i, c in ((4, "r"), (5, "g"), (6, "b"))],
        w[7].cast("double").alias("error"), F.when(n > 0, track).otherwise(F.array().cast("array<struct<image_id:bigint,idx:bigint>>")).alias("track"),
    )


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Records of two lines; a file is one unit, as the second line may be empty."""
    files = spark.read.format("binaryFile").load(path).select("content")

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                lines = [x for x in content.decode().split("\n") if not x.lstrip().startswith("#")]
                out = []
                for head, tail in zip(lines[0::2], lines[1::2] + [""]):
                    w = head.split()
                    if len(w) < 9:
                        continue
                    p = tail.split()
                    points = [{"x": float(a), "y": float(b), "point3d_id": None if int(c) == -1 else int(c)} for a, b, c in zip(p[0::3], p[1::3], p[2::3])]
                    out.append((int(w[0]), [float(x) for x in w[1:5]], [float(x) for x in w[5:8]], int(w[8]), w[9] if len(w) > 9 else "", int(w[10]) if len(w) > 10 else 0, points))
                yield pd.DataFrame(out, columns=["image_id", "qvec", "tvec", "camera_id", "name", "cluster_id", "points"])

    return files.mapInPandas(run, IMAGES)


def cameras_text(cameras: DataFrame) -> DataFrame:
    """Text lines of a cameras file (column value)."""
    names = F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("model") + 1)
    return cameras.select(F.concat_ws(" ", "camera_id", names, "width", "height", F.array_join(F.transform("params", lambda x: x.cast("string")), " ")).alias("value"))


def images_text(images: DataFrame) -> DataFrame:
    numbers = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    points = F.array_join(F.transform("points", lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"), F.coalesce(p["point3d_id"], F.lit(-1)).cast("string"))), " ")
    head = F.concat_ws(" ", "image_id", numbers("qvec"), numbers("tvec"), "camera_id", "name", "cluster_id")
    return images.select(F.concat(head, F.lit("\n"), points).alias("value"))


def points_text(points: DataFrame) -> DataFrame:
    track = F.array_join(F.transform("track", lambda t: F.concat_ws(" ", t["image_id"].cast("string"), t["idx"].cast("string"))), " ")
    return points.select(F.concat_ws(" ", "point3d_id", "x", "y", "z", "r", "g", "b", "error", track).alias("value"))


# Binary ---------------------------------------------------------------------------


def _cameras(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        camera, model, width, height = struct.unpack_from("<iiQQ", data, at)
        at += 24
        n = N_PARAMS[model]
        yield camera, model, width, height, list(struct.unpack_from(f"<{n}d", data, at))
        at += 8 * n


def _images(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        image, cluster = struct.unpack_from("<IQ", data, at)
        pose = struct.unpack_from("<7d", data, at + 12)
        camera = struct.unpack_from("<I", data, at + 68)[0]
        end = data.index(b"\0", at + 72)
        name = data[at + 72 : end].decode()
        n = struct.unpack_from("<Q", data, end + 1)[0]
        rows = np.frombuffer(data, dtype=[("x", "<f8"), ("y", "<f8"), ("p", "<u8")], count=n, offset=end + 9)
        points = [{"x": float(x), "y": float(y), "point3d_id": None if p == NO_POINT else int(p)} for x, y, p in rows]
        yield image, list(pose[:4]), list(pose[4:]), camera, name, cluster, points
        at = end + 9 + 24 * n


def _points(data: bytes) -> Iterator[tuple]:
    at = 8
    for _ in range(struct.unpack_from("<Q", data)[0]):
        point, x, y, z, r, g, b, error, n = struct.unpack_from("<Q3d3BdQ", data, at)
        at += 51
        track = np.frombuffer(data, dtype="<u4", count=2 * n, offset=at).reshape(n, 2)
        yield point, x, y, z, r, g, b, error, [{"image_id": int(i), "idx": int(j)} for i, j in track]
        at += 8 * n


def read_binary(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``cameras``, ``images`` or ``points`` of one or many files (glob)."""
    schema, decode = {"cameras": (CAMERAS, _cameras), "images": (IMAGES, _images), "points": (POINTS, _points)}[table]
    names = [c.strip().split(" ")[0] for c in _top_level(schema)]

    def run(frames):
        import itertools

        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                rows = decode(bytes(content))
                while part := list(itertools.islice(rows, 5000)):
                    yield pd.DataFrame(part, columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


def _top_level(schema: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            out.append(schema[at:i])
            at = i + 1
    return [*out, schema[at:]]


#: The column that numbers a table's records.
_KEYS = {"cameras": "camera_id", "images": "image_id", "points": "point3d_id"}


def _record(table: str, r) -> bytes:
    """One camera, image or point as it stands in a model file."""
    if table == "cameras":
        return struct.pack(f"<iiQQ{len(r['params'])}d", r["camera_id"], r["model"], r["width"], r["height"], *r["params"])
    if table == "images":
        head = struct.pack("<IQ7dI", r["image_id"], r["cluster_id"] or 0, *r["qvec"], *r["tvec"], r["camera_id"]) + r["name"].encode() + b"\0" + struct.pack("<Q", len(r["points"]))
        return head + b"".join(struct.pack("<2dQ", p["x"], p["y"], NO_POINT if p["point3d_id"] is None else p["point3d_id"]) for p in r["points"])
    head = struct.pack("<Q3d3BdQ", r["point3d_id"], r["x"], r["y"], r["z"], r["r"], r["g"], r["b"], r["error"], len(r["track"]))
    return head + b"".join(struct.pack("<II", t["image_id"], t["idx"]) for t in r["track"])


def to_binary(df: DataFrame, table: str) -> bytes:
    """The bytes of a model file; rows are streamed in id order."""
    out = [_record(table, r) for r in df.orderBy(_KEYS[table]).toLocalIterator()]
    return struct.pack("<Q", len(out)) + b"".join(out)


#: Bytes after which a model's next record begins another file.
FILE = 4 << 20


def binary_files(df: DataFrame, table: str, size: int = FILE) -> Iterator[bytes]:
    """A model as several files of about ``size`` bytes, packed by tasks.

    The caller holds the files of one partition at a time, however large the table; a
    table without rows is one file. ``read_binary`` reads them all as one table.
    """

    def run(batches):
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([struct.pack("<Q", len(held)) + b"".join(held)], pa.binary())], ["content"])
        held, length = [], 0
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                for r in batch.slice(low, 500).to_pylist():
                    held.append(_record(table, r))
                    length += len(held[-1])
                    if length >= size:
                        yield packed()
                        held, length = [], 0
        if held:
            yield packed()

    none = True
    for r in df.mapInArrow(run, "content binary").toLocalIterator():
        none = False
        yield bytes(r["content"])
    if none:
        yield struct.pack("<Q", 0)


# Exports --------------------------------------------------------------------------


def ply_lines(points: DataFrame) -> DataFrame:
    """ASCII PLY body lines; ``ply_header`` gives the header."""
    return points.select(F.concat_ws(" ", "x", "y", "z", "r", "g", "b").alias("value"))


def ply_header(n: int) -> str:
    kinds = [("float", c) for c in "xyz"] + [("uchar", c) for c in ("red", "green", "blue")]
    return "\n".join(["ply", "format ascii 1.0", f"element vertex {n}", *[f"property {k} {c}" for k, c in kinds], "end_header"])


def nvm_lines(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera lines of an NVM file: name, focal length, rotation, centre, distortion."""
    from skein.functions import geometry as g

    q, t = tuple(F.col("qvec")[i] for i in range(4)), tuple(F.col("tvec")[i] for i in range(3))
    rows = images.join(cameras.select("camera_id", "params"), "camera_id")
    return rows.select(F.concat_ws(" ", "name", F.col("params")[0].cast("string"), *[c.cast("string") for c in (*q, *g.centre(q, t))], F.lit("0 0")).alias("value"))


def bundler_lines(images: DataFrame, cameras: DataFrame) -> DataFrame:
    """Camera blocks of a Bundler file (y and z point the other way)."""
    from skein.functions import geometry as g

    q, t = tuple(F.col("qvec")[i] for i in range(4)), tuple(F.col("tvec")[i] for i in range(3))
    m, sign = g.to_matrix(q), (1, -1, -1)
    rows = [F.concat_ws(" ", *[(c * s).cast("string") for c in row]) for row, s in zip(m, sign)]
    last = F.concat_ws(" ", *[(c * s).cast("string") for c, s in zip(t, sign)])
    joined = images.join(cameras.select("camera_id", "params"), "camera_id")
    return joined.select("image_id", F.concat_ws("\n", F.concat_ws(" ", F.col("params")[0].cast("string"), F.lit("0 0")), *rows, last).alias("value"))


def vrml_lines(points: DataFrame) -> DataFrame:
    """Coordinate lines of a VRML point set."""
    return points.select(F.concat(F.concat_ws(", ", "x", "y", "z"), F.lit(",")).alias("value"))


BUNDLER_VIEWS = "image_id bigint, f double, k1 double, k2 double, r array<double>, t array<double>"
BUNDLER_POINTS = "point_id bigint, x double, y double, z double, r int, g int, b int, track array<struct<image_id:bigint,idx:bigint,x:double,y:double>>"


def _bundler(content: bytes) -> tuple[list[tuple], list[tuple]]:
    words = [w for line in content.decode().split("\n") if not line.startswith("#") for w in line.split()]
    n, m = int(words[0]), int(words[1])
    at, images, points = 2, [], []
    for i in range(n):
        v = list(map(float, words[at : at + 15]))
        images.append((i, *v[:3], v[3:12], v[12:]))
        at += 15
    for i in range(m):
        k = int(words[at + 6])
        rows = [words[at + 7 + 4 * j : at + 11 + 4 * j] for j in range(k)]
        track = [{"image_id": int(a), "idx": int(b), "x": float(c), "y": float(d)} for a, b, c, d in rows]
        points.append((i, *map(float, words[at : at + 3]), *map(int, words[at + 3 : at + 6]), track))
        at += 7 + 4 * k
    return images, points


def _useful(line: str) -> bool:
    return not line.startswith("#") and bool(line.strip())


def _pieces(batches):
    """The useful lines of each piece of a file, as (file, start, lines) a batch; rows: (file, start, value)."""
    for batch in batches:
        files, starts, values = (batch.column(i).to_pylist() for i in range(3))
        low = 0
        for i in range(1, len(files) + 1):
            if i == len(files) or (files[i], starts[i]) != (files[low], starts[low]):
                yield files[low], starts[low], [x for x in values[low:i] if _useful(x)]
                low = i


def _point_batch(rows: list[tuple[int, str, str, str]]):
    """(point_id, position, colour and track lines) as columns of ``BUNDLER_POINTS``."""
    import pyarrow as pa

    each = [(i, *(x.split() for x in lines)) for i, *lines in rows]
    if any(len(xyz) != 3 or len(rgb) != 3 or len(w) != 1 + 4 * int(w[0]) for _, xyz, rgb, w in each):
        raise ValueError("a point of a Bundler file does not stand on three lines")
    flat = [[kind(x) for _, _, _, w in each for x in w[at::4]] for at, kind in ((1, int), (2, int), (3, float), (4, float))]
    track = pa.StructArray.from_arrays([pa.array(x, k) for x, k in zip(flat, (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["image_id", "idx", "x", "y"])
    ends = np.cumsum([0, *(int(w[0]) for *_, w in each)])
    columns = [pa.array([i for i, *_ in each], pa.int64()), *(pa.array([float(p[j]) for _, p, _, _ in each], pa.float64()) for j in range(3)), *(pa.array([int(c[j]) for _, _, c, _ in each], pa.int32()) for j in range(3))]
    return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), track)], ["point_id", "x", "y", "z", "r", "g", "b", "track"])


#: Lines whose points are parsed at a time.
_LINES = 3 * 2_000


def _bundler_points(spark: SparkSession, path: str) -> DataFrame | None:
    """Points of Bundler files whose points stand on three lines each, piece by piece of a
    file; None if the number of lines says otherwise.

    The lines of each piece are counted first, which numbers all lines; the few points that stand in two
    pieces are put together from the pieces' first and last lines.
    """
    import pyarrow as pa

    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")

    def count(batches):
        now, n, head, tail = None, 0, [], []

        def row():
            return pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]], pa.int64()), pa.array([n], pa.int64()), pa.array([head], pa.list_(pa.string())), pa.array([tail], pa.list_(pa.string()))], ["file", "start", "n", "head", "tail"])

        for file, start, some in _pieces(batches):
            if (file, start) != now:
                if now is not None:
                    yield row()
                now, n, head, tail = (file, start), 0, [], []
            head = (head + some[:3])[:3]
            n, tail = n + len(some), (tail + some[-2:])[-2:]
        if now is not None:
            yield row()

    pieces = lines.mapInArrow(count, "file string, start bigint, n bigint, head array<string>, tail array<string>").collect()  # a row a piece
    first, skip, loose, files = {}, {}, [], {}
    for r in sorted(pieces, key=lambda r: (r["file"], r["start"])):
        if r["n"]:
            files.setdefault(r["file"], []).append(r)
    for file, own in files.items():
        head = own[0]["head"][0].split()
        if len(head) != 2 or sum(r["n"] for r in own) != 1 + 5 * int(head[0]) + 3 * int(head[1]):
            return None
        skip[file], at, known = 1 + 5 * int(head[0]), 0, {}
        for r in own:
            first[file, r["start"]] = at
            ends = {**dict(enumerate(r["head"], at)), **dict(enumerate(r["tail"], at + r["n"] - len(r["tail"])))}
            known |= {i: (x, r["start"]) for i, x in ends.items() if i >= skip[file]}
            at += r["n"]
        for i in sorted({(i - skip[file]) // 3 for i in known}):
            three = [known.get(skip[file] + 3 * i + j) for j in range(3)]
            if all(three) and len({x[1] for x in three}) > 1:
                loose.append((i, *(x[0] for x in three)))

    def parse(batches):
        now, at, held = None, 0, []
        for file, start, some in _pieces(batches):
            if (file, start) != now:
                now, at, held = (file, start), first.get((file, start), 0), []
            for x in some:
                j, at = at - skip[file], at + 1
                # A point that begins in the piece before is put together elsewhere.
                if j >= 0 and (held or j % 3 == 0):
                    held.append(x)
                    if len(held) == _LINES:
                        yield _point_batch([(j // 3 - len(held) // 3 + 1 + i, *held[3 * i : 3 * i + 3]) for i in range(len(held) // 3)])
                        held = []
            if len(held) >= 3:
                whole = len(held) // 3
                begin = (at - skip[file] - len(held)) // 3
                yield _point_batch([(begin + i, *held[3 * i : 3 * i + 3]) for i in range(whole)])
                held = held[3 * whole :]

    found = lines.mapInArrow(parse, BUNDLER_POINTS)
    if not loose:
        return found
    few = spark.createDataFrame(loose, "point_id bigint, a string, b string, c string")

    def join(batches):
        for batch in batches:
            if batch.num_rows:
                yield _point_batch(list(zip(*(c.to_pylist() for c in batch.columns))))

    return found.unionByName(few.mapInArrow(join, BUNDLER_POINTS))


def read_bundler(spark: SparkSession, path: str, table: str = "points") -> DataFrame:
    """``images`` or ``points`` of Bundler files (the model of PMVS folders too)."""
    if table != "images" and (found := _bundler_points(spark, path)) is not None:
        return found
    schema = BUNDLER_VIEWS if table == "images" else BUNDLER_POINTS
    names = [c.strip().split(" ")[0] for c in _top_level(schema)]

    def run(frames):
        import pandas as pd

        for frame in frames:
            for content in frame["content"]:
                yield pd.DataFrame(_bundler(bytes(content))[table != "images"], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, schema)


PROJECTIONS = "image_id bigint, k array<double>, r array<double>, t array<double>"
#: Numbered names of the files of a PMVS folder.
_NUMBERED = r"(\d+)\.txt$"


def decompose_projection(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Calibration (without skew, last element 1), rotation and translation of a 3x4 matrix."""
    p = p if np.linalg.det(p[:, :3]) >= 0 else -p
    k, r = rq(p[:, :3])
    t = np.linalg.solve(k, p[:, 3])
    k = np.diag(np.diag(k)) + np.outer(k[:, 2] * [1, 1, 0], [0, 0, 1])
    return k / k[2, 2], r, t


def read_projections(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a PMVS folder without Bundler file: ``txt/NUMBER.txt`` holds CONTOUR and
    the 12 numbers of a projection matrix. Row-major ``k`` and ``r``."""

    def run(frames):
        import pandas as pd

        for frame in frames:
            out = []
            for image, words in zip(frame["image_id"], frame["words"]):
                k, r, t = decompose_projection(np.array([float(w) for w in words[1:13]]).reshape(3, 4))
                out.append((image, k.ravel().tolist(), r.ravel().tolist(), t.tolist()))
            yield pd.DataFrame(out, columns=["image_id", "k", "r", "t"])

    files = spark.read.text(path.rstrip("/") + "/txt", wholetext=True)
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    rows = files.select(F.regexp_extract(F.input_file_name(), _NUMBERED, 1).cast("long").alias("image_id"), words.alias("words"))
    return rows.filter((F.element_at("words", 1) == "CONTOUR") & (F.size("words") >= 13)).mapInPandas(run, PROJECTIONS)


def read_visible(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, other) of a PMVS folder's ``vis.dat``: the images to use with each other,
    one image a line behind its number and how many follow; itself left out."""
    lines = _lines(spark, path.rstrip("/") + "/vis.dat").filter("size(w) > 2")
    rows = lines.select(F.col("w")[0].cast("long").alias("image_id"), F.explode(F.slice("w", 3, F.size("w")).cast("array<bigint>")).alias("other"))
    return rows.filter("image_id <> other")


def inlier_pairs(geometries: DataFrame, images: DataFrame, least: int = 15) -> DataFrame:
    """Names of verified pairs (name1, name2, inliers)."""
    ids = images.select("image_id", "name")
    rows = geometries.select("image_id1", "image_id2", F.size("matches").cast("long").alias("inliers")).filter(F.col("inliers") >= least)
    return rows.join(ids.select(F.col("image_id").alias("image_id1"), F.col("name").alias("name1")), "image_id1").join(ids.select(F.col("image_id").alias("image_id2"), F.col("name").alias("name2")), "image_id2").select("name1", "name2", "inliers")


def gml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge blocks of a GML graph."""
    a = nodes.select(F.format_string("node [ id %d label \"%d\" ]", "id", "label").alias("value"))
    return a.unionByName(edges.select(F.format_string("edge [ source %d target %d value %s ]", "src", "dst", F.col("weight").cast("string")).alias("value")))
