"""Other files: PLY, dense arrays, consistency graphs, feature lists, match blocks."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_PLY_TYPES = {"float": "f4", "float32": "f4", "double": "f8", "float64": "f8", "uchar": "u1", "uint8": "u1", "char": "i1", "int": "i4", "int32": "i4", "uint": "u4", "short": "i2", "ushort": "u2"}


def decode_ply(data: bytes) -> np.ndarray:
    """Vertices of an ASCII or binary PLY file as a record array."""
    end = data.index(b"end_header") + len(b"end_header")
    head = data[:end].decode().split("\n")
    body = data[data.index(b"\n", end) + 1 :]
    form, n, fields, inside = "ascii", 0, [], False
    for line in head:
        w = line.split()
        if w[:1] == ["format"]:
            form = w[1]
        elif w[:1] == ["element"]:
            inside = w[1] == "vertex"
            n = int(w[2]) if inside else n
        elif w[:1] == ["property"] and inside:
            fields.append((w[2], _PLY_TYPES[w[1]]))
    if form == "ascii":
        rows = [tuple(map(float, x.split()[: len(fields)])) for x in body.decode().strip().split("\n")[:n]]
        return np.array(rows, dtype=[(a, "f8") for a, _ in fields])
    order = "<" if form == "binary_little_endian" else ">"
    return np.frombuffer(body, dtype=[(a, order + b) for a, b in fields], count=n)


def _binary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def read_ply(spark: SparkSession, path: str) -> DataFrame:
    """Points (path, idx, x, y, z, r, g, b); black without colours."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                v = decode_ply(bytes(content))
                colour = lambda *names: next((v[c].astype(int) for c in names if c in v.dtype.names), np.zeros(len(v), dtype=int))  # noqa: B023, E731
                yield pd.DataFrame({"path": name, "idx": np.arange(len(v)), "x": v["x"].astype(float), "y": v["y"].astype(float), "z": v["z"].astype(float), "r": colour("red", "r"), "g": colour("green", "g"), "b": colour("blue", "b")})

    return _binary(spark, path).mapInPandas(run, "path string, idx bigint, x double, y double, z double, r int, g int, b int")


def decode_array(data: bytes) -> np.ndarray:
    """A dense array ``W&H&C&`` + floats as (H, W, C)."""
    w, h, c, body = data.split(b"&", 3)
    return np.frombuffer(body, dtype="<f4").reshape(int(c), int(h), int(w)).transpose(1, 2, 0)


def encode_array(a: np.ndarray) -> bytes:
    h, w, c = a.shape
    return f"{w}&{h}&{c}&".encode() + np.ascontiguousarray(a.transpose(2, 0, 1), dtype="<f4").tobytes()


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Cells of dense arrays (path, row, col, channel, value), a row block at a time."""

    def run(frames):
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                a = decode_array(bytes(content))
                for row in range(a.shape[0]):
                    col, channel = np.meshgrid(np.arange(a.shape[1]), np.arange(a.shape[2]), indexing="ij")
                    yield pd.DataFrame({"path": name, "row": row, "col": col.ravel(), "channel": channel.ravel(), "value": a[row].ravel().astype(float)})

    return _binary(spark, path).mapInPandas(run, "path string, row int, col int, channel int, value double")


def decode_consistency(data: bytes) -> list[tuple[int, int, list[int]]]:
    """(row, col, image ids) of a consistency graph after its array header."""
    *_, body = data.split(b"&", 3)
    v, out, at = np.frombuffer(body, dtype="<i4"), [], 0
    while at < len(v):
        n = int(v[at + 2])
        out.append((int(v[at + 1]), int(v[at]), v[at + 3 : at + 3 + n].tolist()))
        at += 3 + n
    return out


def encode_consistency(width: int, height: int, rows: list[tuple[int, int, list[int]]]) -> bytes:
    return f"{width}&{height}&1&".encode() + b"".join(struct.pack(f"<{3 + len(ids)}i", col, row, len(ids), *ids) for row, col, ids in rows)


def read_features_text(spark: SparkSession, path: str) -> DataFrame:
    """Features (path, idx, x, y, scale, orientation, descriptor) from text files:
    a header "n dims", then a line each."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), F.split(F.trim("value"), r"\s+").alias("w"), F.monotonically_increasing_id().alias("_i"))
    w = F.col("w")
    rows = lines.filter(F.size(w) > 4)
    from pyspark.sql import Window

    place = Window.partitionBy("path").orderBy("_i")
    return rows.select("path", (F.row_number().over(place) - 1).alias("idx"), *[w[i].cast("float").alias(c) for i, c in enumerate(("x", "y", "scale", "orientation"))], F.transform(F.slice(w, 5, 10_000), lambda x: x.cast("smallint")).alias("descriptor"))


def read_match_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(name1, name2, idx1, idx2) from blocks: a line of names, lines of indices, a
    blank line. A file is one unit."""

    def run(frames):
        for frame in frames:
            for content in frame["content"]:
                out, names = [], None
                for line in bytes(content).decode().split("\n"):
                    w = line.split()
                    if line.startswith("#"):
                        continue
                    if not w:
                        names = None
                    elif names is None:
                        names = w[:2]
                    else:
                        out.append((*names, int(w[0]), int(w[1])))
                yield pd.DataFrame(out, columns=["name1", "name2", "idx1", "idx2"])

    return _binary(spark, path).mapInPandas(run, "name1 string, name2 string, idx1 int, idx2 int")


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """Rows of .npy matrices (path, region, embedding)."""

    def run(frames):
        import io

        for frame in frames:
            for name, content in zip(frame["path"], frame["content"]):
                a = np.atleast_2d(np.load(io.BytesIO(bytes(content)), allow_pickle=False))
                yield pd.DataFrame({"path": name, "region": np.arange(len(a)), "embedding": list(a.astype(float))})

    return _binary(spark, path).mapInPandas(run, "path string, region int, embedding array<double>")


def list_images(spark: SparkSession, path: str) -> DataFrame:
    """Images below a folder (name relative to it, folder, length), by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    base = path.rstrip("/").split("://")[-1].lstrip("/")
    name = F.regexp_replace("path", f"^.*?{base.replace('.', '[.]')}/", "")
    return files.select(name.alias("name"), F.regexp_replace(name, "/?[^/]*$", "").alias("folder"), "length").orderBy("name")


def assign_cameras(images: DataFrame, policy: str = "image") -> DataFrame:
    """camera_id by policy: one camera, one a folder, or one an image."""
    from skein.operators.pairs import numbered

    if policy == "single":
        return images.withColumn("camera_id", F.lit(1).cast("long"))
    key = {"folder": "folder", "image": "name"}[policy]
    ids = numbered(images.select(key).distinct(), [key], "camera_id").withColumn("camera_id", F.col("camera_id") + 1)
    return images.join(ids, key)


def sensor_widths(cameras: DataFrame, specs: DataFrame) -> DataFrame:
    """Sensor width by make and model (both in lower case, without blanks or dashes).

    ``specs``: (make, model, sensor_mm), the caller's table.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.col(c)), r"[\s-]", "")
    known = specs.groupBy(plain("make").alias("_make"), plain("model").alias("_model")).agg(F.max("sensor_mm").alias("sensor_mm"))
    return cameras.withColumn("_make", plain("make")).withColumn("_model", plain("model")).join(known, ["_make", "_model"], "left").drop("_make", "_model")
