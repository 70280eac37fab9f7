"""SQLite stores: the six tables with matrices in blobs, to and from DataFrames.

One task reads one file; several files (partial stores) are read side by side.
Rows are fetched in bounded batches. SQLite needs a local path, so files are
shipped to the executors through Spark (``addFile``).
"""

from __future__ import annotations

import os
import sqlite3
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from skein.operators.pairs import BASE
from skein.operators.store import SCHEMAS

_BATCH = 2_000


def keypoints(data: bytes, rows: int, cols: int) -> np.ndarray:
    """Decoded keypoints (rows, 6): x, y and the affine shape.

    Two columns have unit shape, four hold scale and orientation, six the shape.
    """
    raw = np.frombuffer(data, dtype="<f4").reshape(rows, cols)
    out = np.zeros((rows, 6), dtype=np.float32)
    out[:, :2] = raw[:, :2]
    if cols == 2:
        out[:, 2], out[:, 5] = 1, 1
    elif cols == 4:
        s, c, n = raw[:, 2], np.cos(raw[:, 3]), np.sin(raw[:, 3])
        out[:, 2], out[:, 3], out[:, 4], out[:, 5] = s * c, -s * n, s * n, s * c
    elif cols == 6:
        out[:, 2:] = raw[:, 2:]
    else:
        raise ValueError(f"keypoints of {cols} columns")
    return out


def _pairs(blob, rows: int) -> list[dict]:
    m = np.frombuffer(blob or b"", dtype="<u4").reshape(rows, 2)
    return [{"idx1": int(a), "idx2": int(b)} for a, b in m]


def _doubles(blob) -> list[float] | None:
    return None if blob is None else np.frombuffer(blob, dtype="<f8").tolist()


def _unpair(pair: int) -> tuple[int, int]:
    return (pair - pair % BASE) // BASE, pair % BASE


def _columns(table: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in SCHEMAS[table].replace("struct<idx1:int,idx2:int>", "s").split(", ")]


def decode(table: str, row: dict) -> list[tuple]:
    """The DataFrame rows of one SQLite row."""
    if table == "cameras":
        return [(row["camera_id"], row["model"], row["width"], row["height"], _doubles(row["params"]), bool(row["prior_focal_length"]))]
    if table == "images":
        prior = lambda names: None if row[names[0]] is None else [row[n] for n in names]
        return [(row["image_id"], row["name"], row["camera_id"], prior(["prior_qw", "prior_qx", "prior_qy", "prior_qz"]), prior(["prior_tx", "prior_ty", "prior_tz"]))]
    n, data = row["rows"], row["data"]
    if table == "keypoints":
        return [(row["image_id"], i, *map(float, k)) for i, k in enumerate(keypoints(data or b"", n, row["cols"]))] if n else []
    if table == "descriptors":
        return [(row["image_id"], i, d.tolist()) for i, d in enumerate(np.frombuffer(data or b"", dtype=np.uint8).reshape(n, row["cols"]))] if n else []
    a, b = _unpair(row["pair_id"])
    listed = _pairs(data, n)
    if table == "matches":
        return [(row["pair_id"], a, b, listed)]
    # The relative pose is kept in the columns F (quaternion) and E (translation).
    return [(row["pair_id"], a, b, listed, row["config"], _doubles(row.get("F")), _doubles(row.get("E")))]


def read(spark: SparkSession, paths: list[str], table: str) -> DataFrame:
    """One table of one or more stores, with ``source`` (the file's name)."""
    for path in paths:
        spark.sparkContext.addFile(path)
    names = spark.createDataFrame([(os.path.basename(p),) for p in paths], "source string").repartition(len(paths), "source")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name in frame["source"]:
                with sqlite3.connect(f"file:{SparkFiles.get(name)}?mode=ro", uri=True) as store:
                    store.row_factory = sqlite3.Row
                    if not store.execute("SELECT 1 FROM sqlite_master WHERE name = ?", (table,)).fetchone():
                        continue
                    cursor = store.execute(f"SELECT * FROM {table}")
                    while batch := cursor.fetchmany(_BATCH):
                        rows = [r for x in batch for r in decode(table, dict(x))]
                        if rows:
                            out = pd.DataFrame(rows, columns=_columns(table))
                            out["source"] = name
                            yield out

    return names.mapInPandas(run, SCHEMAS[table] + ", source string")


_CREATE = {
    "cameras": "camera_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, model INTEGER NOT NULL, width INTEGER NOT NULL, height INTEGER NOT NULL, params BLOB, prior_focal_length INTEGER NOT NULL",
    "images": "image_id INTEGER PRIMARY KEY AUTOINCREMENT NOT NULL, name TEXT NOT NULL UNIQUE, camera_id INTEGER NOT NULL, prior_qw REAL, prior_qx REAL, prior_qy REAL, prior_qz REAL, prior_tx REAL, prior_ty REAL, prior_tz REAL",
    "keypoints": "image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB",
    "descriptors": "image_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB",
    "matches": "pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB",
    "two_view_geometries": "pair_id INTEGER PRIMARY KEY NOT NULL, rows INTEGER NOT NULL, cols INTEGER NOT NULL, data BLOB, config INTEGER NOT NULL, F BLOB, E BLOB, H BLOB",
}


def write(path: str, tables: dict[str, DataFrame]) -> None:
    """Export tables into one SQLite file on the driver, streamed row by row."""

    def doubles(v):
        return None if v is None else np.asarray(v, dtype="<f8").tobytes()

    with sqlite3.connect(path) as store:
        for name, columns in _CREATE.items():
            store.execute(f"CREATE TABLE IF NOT EXISTS {name} ({columns})")
        for name, df in tables.items():
            marks = ", ".join("?" * len(_CREATE[name].split(", ")))
            insert = f"INSERT INTO {name} VALUES ({marks})"
            if name in ("keypoints", "descriptors"):
                kind, held = "<f4" if name == "keypoints" else "u1", []

                def flush(image, rows, kind=kind, insert=insert):
                    m = np.array(rows, dtype=kind)
                    store.execute(insert, (image, len(m), m.shape[1], m.tobytes()))

                last = None
                for r in df.orderBy("image_id", "point2d_idx").toLocalIterator():
                    if last is not None and r["image_id"] != last:
                        flush(last, held)
                        held = []
                    last = r["image_id"]
                    held.append(list(r["descriptor"]) if name == "descriptors" else [r[c] for c in ("x", "y", "a11", "a12", "a21", "a22")])
                if held:
                    flush(last, held)
                continue
            for r in df.toLocalIterator():
                if name == "cameras":
                    row = (r["camera_id"], r["model"], r["width"], r["height"], doubles(r["params"]), int(r["prior_focal_length"]))
                elif name == "images":
                    row = (r["image_id"], r["name"], r["camera_id"], *(r["prior_q"] or [None] * 4), *(r["prior_t"] or [None] * 3))
                else:
                    m = np.array([(x["idx1"], x["idx2"]) for x in r["matches"]], dtype="<u4").reshape(-1, 2)
                    row = (r["pair_id"], len(m), 2, m.tobytes())
                    if name == "two_view_geometries":
                        row += (r["config"], doubles(r["qvec"]), doubles(r["tvec"]), None)
                store.execute(insert, row)
