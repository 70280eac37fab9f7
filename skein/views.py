"""The scene: the data model as views over the given tables.

Each view is one SQL text in the dialect that Spark and DuckDB share. ``{name}``
stands for another view or a base table. ``frame`` builds it in Spark, ``with_``
gives the same views as a WITH clause.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

from skein.session import cut, cut_packed, unpack

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

VIEWS: dict[str, str] = {
    # One row per (image, point); idx numbers an image's observations from 0.
    "obs": """SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY point_id) - 1 AS BIGINT) AS idx, point_id, x, y
        FROM (SELECT l_orderkey AS image_id, l_partkey AS point_id, min(l_extendedprice) AS x, min(l_quantity) AS y FROM {lineitem} GROUP BY l_orderkey, l_partkey) t""",
    "images": """SELECT o_orderkey AS image_id, lpad(CAST(o_orderkey AS STRING), 10, '0') AS name, o_orderkey % (SELECT count(*) FROM {supplier}) AS camera_id,
        CAST(o_orderkey % 360 AS DOUBLE) / 57.0 / 2 AS half_yaw,
        CAST(o_orderkey % 7 - 3 AS DOUBLE) AS tx, CAST(o_orderkey % 5 - 2 AS DOUBLE) AS ty, CAST(o_orderkey % 80 - 9 AS DOUBLE) AS tz,
        CAST(o_orderkey % 97 AS DOUBLE) / 100 + 47 AS lat, CAST(o_orderkey % 89 AS DOUBLE) / 100 + 11 AS lon, CAST(o_orderkey % 300 AS DOUBLE) AS alt
        FROM {orders}""",
    "cameras": """SELECT CAST(s_suppkey AS BIGINT) AS camera_id, CAST(s_suppkey % 3 AS INT) AS model, 1024 AS width, 768 AS height,
        CAST(500 + s_suppkey % 300 AS DOUBLE) AS f, 512.0D AS cx, 384.0D AS cy, CAST(s_suppkey % 5 AS DOUBLE) / 50 - 0.04D AS k1,
        CAST(s_suppkey % 79 AS DOUBLE) / 100 + 47 AS lat, CAST(s_suppkey % 53 AS DOUBLE) / 100 + 11 AS lon, s_suppkey % 4 = 0 AS prior_focal
        FROM {supplier}""",
    "points": """SELECT p_partkey AS point_id, CAST(p_size - 25 AS DOUBLE) AS px, CAST(p_partkey % 41 - 20 AS DOUBLE) AS py, CAST(p_partkey % 17 - 8 AS DOUBLE) AS pz,
        CAST(p_partkey % 256 AS INT) AS r, CAST(p_partkey % 199 AS INT) AS g, CAST(p_partkey % 97 AS INT) AS b, p_retailprice
        FROM {part}""",
    # Pairs of images that share points.
    "covis": """SELECT a.image_id AS image_id1, b.image_id AS image_id2, count(*) AS shared
        FROM {obs} a JOIN {obs} b ON a.point_id = b.point_id AND a.image_id < b.image_id GROUP BY a.image_id, b.image_id""",
    "sparse": "SELECT image_id1, image_id2, shared FROM {covis} WHERE shared >= 2",
    # A dense weighted graph: suppliers that supply the same parts.
    "dense": """SELECT a.s AS src, b.s AS dst, count(*) AS weight
        FROM (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem}) a JOIN (SELECT DISTINCT l_suppkey AS s, l_partkey AS p FROM {lineitem}) b
        ON a.p = b.p AND a.s < b.s GROUP BY a.s, b.s""",
    # Its heavy edges with a relative rotation (about z, in degrees) on each.
    "viewgraph": """SELECT src, dst, weight, CAST((dst - src) * 7 % 360 AS DOUBLE) + CASE WHEN (src * 13 + dst * 5) % 4 = 0 THEN 9.0D ELSE CAST((src + dst) % 3 AS DOUBLE) / 2 END AS turn
        FROM {dense} WHERE weight > (SELECT avg(weight) + 0.7D * stddev_pop(weight) FROM {dense})""",
    # Feature matches between images of the sparse graph (through common points).
    "matches": """SELECT a.image_id AS image_id1, b.image_id AS image_id2, a.idx AS idx1, b.idx AS idx2
        FROM {sparse} s JOIN {obs} a ON a.image_id = s.image_id1 JOIN {obs} b ON b.image_id = s.image_id2 AND b.point_id = a.point_id""",
    # Observations with the pixel at which a slightly wrong camera sees the point.
    "seen": """SELECT o.image_id, o.idx, o.point_id, i.camera_id, i.tx, i.ty, i.tz, i.half_yaw, p.px, p.py, p.pz, c.f, c.cx, c.cy, c.width, c.height,
        c.cx + CAST((o.image_id * 31 + o.point_id * 17) % 1000 AS DOUBLE) - 500 AS x, c.cy + CAST((o.image_id * 7 + o.point_id * 3) % 700 AS DOUBLE) - 350 AS y
        FROM {obs} o JOIN {images} i ON o.image_id = i.image_id JOIN {cameras} c ON i.camera_id = c.camera_id JOIN {points} p ON o.point_id = p.point_id""",
    # Words of documents: a document is an image, a word a visual word.
    "words": r"""SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, unnest(string_split(lower(text), ' ')) AS word FROM {documents}) t WHERE word <> '' GROUP BY doc_id, word""",
}

#: Spark's form of views whose functions are named differently, or whose plan matters.
SPARK: dict[str, str] = {
    # Parts that stand together share suppliers: in ranges of parts most of the pairs are
    # counted before they are shuffled (``_counted``), and a part travels as its list of suppliers.
    "dense": """SELECT sort_array(collect_set(l_suppkey)) AS l FROM (SELECT /*+ REPARTITION_BY_RANGE(l_partkey) */ l_suppkey, l_partkey FROM {lineitem} WHERE l_partkey IS NOT NULL) GROUP BY l_partkey""",
    "words": r"""SELECT doc_id, word, count(*) AS tf FROM (SELECT doc_id, explode(split(lower(text), ' ')) AS word FROM {documents}) t WHERE word <> '' GROUP BY doc_id, word""",
}


#: Pairs that a task counts at a time, and buckets of pairs by their first number.
_PAIRS, _BUCKETS = 1 << 21, 256


def _summed(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once with its whole weight, by (src, dst)."""
    order = np.lexsort((dst, src))
    src, dst, weight = src[order], dst[order], weight[order]
    first = np.flatnonzero(np.r_[True, (src[1:] != src[:-1]) | (dst[1:] != dst[:-1])]) if len(src) else np.zeros(0, dtype=np.int64)
    return src[first], dst[first], np.add.reduceat(weight, first) if len(first) else weight


def _pair_blobs(src: np.ndarray, dst: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(bucket, blob): counted pairs as compressed differences."""
    src, dst, weight = _summed(src, dst, np.ones(len(src), dtype=np.int64))
    bucket = ((src.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % _BUCKETS
    order = np.argsort(bucket, kind="stable")
    table = pa.table({"src": src[order], "dst": dst[order], "weight": weight[order]})
    found, first = np.unique(bucket[order], return_index=True)
    for k, low, high in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
        out = pa.BufferOutputStream()
        pq.write_table(table.slice(low, high - low), out, compression="zstd", write_statistics=False, use_dictionary=["weight"], column_encoding={c: "DELTA_BINARY_PACKED" for c in ("src", "dst")})
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([out.getvalue().to_pybytes()], pa.binary())], ["bucket", "blob"])


def _listed_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0
    for batch in batches:
        lists = batch.column(0)
        value, size = lists.flatten().to_numpy(), pa.compute.list_value_length(lists).to_numpy()
        ahead = np.repeat(np.cumsum(size), size) - np.arange(len(value)) - 1  # later ones of the same list
        total = np.concatenate([[0], np.cumsum(ahead)])
        start = 0
        while start < len(value):
            end = max(start + 1, int(np.searchsorted(total, total[start] + _PAIRS - n, side="right")) - 1)
            count = ahead[start:end]
            one = np.repeat(np.arange(start, end), count)
            two = one + 1 + np.arange(len(one)) - np.repeat(total[start:end] - total[start], count)
            held.append((value[one], value[two]))
            n, start = n + len(one), end
            if start < len(value) or n >= _PAIRS:
                yield from _pair_blobs(*(np.concatenate(x) for x in zip(*held)))
                held, n = [], 0
    if n:
        yield from _pair_blobs(*(np.concatenate(x) for x in zip(*held)))


def _counted(lists: DataFrame) -> DataFrame:
    """(src, dst, weight): how many of the sorted lists hold both numbers."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, most = [], 0, 2 * _PAIRS
        for batch in batches:
            for blob in batch.column("blob"):
                table = unpack(blob.as_py())
                held.append([table.column(c).to_numpy() for c in ("src", "dst", "weight")])
                n += table.num_rows
                if n >= most:
                    held = [_summed(*(np.concatenate(x) for x in zip(*held)))]
                    n = len(held[0][0])
                    most = max(most, 2 * n)
        found = _summed(*(np.concatenate(x) for x in zip(*held)))
        for low in range(0, len(found[0]), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(x[low : low + (1 << 16)]) for x in found], ["src", "dst", "weight"])

    return lists.mapInArrow(_listed_pairs, "bucket int, blob binary").groupBy("bucket").applyInArrow(run, "src bigint, dst bigint, weight bigint")


def _parts(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


#: Small results of wide joins: stored once where several views use them.
STORED = ("sparse", "dense")
#: Of these, tables of numbers without nulls that are stored as compressed columns.
PACKED = ("dense",)


def frame(spark: SparkSession, sf_dir: str, name: str, known: dict[str, DataFrame] | None = None) -> DataFrame:
    """A base table or view as a DataFrame.

    ``known`` keeps what was built, and stores the views of ``STORED``.
    """
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if known is not None and name in known:
        return known[name]
    sql = SPARK.get(name, VIEWS[name])
    out = spark.sql(sql, **{p: frame(spark, sf_dir, p, known) for p in _parts(sql)})
    out = _counted(out) if name == "dense" else out
    if known is not None:
        known[name] = out = cut_packed(out) if name in PACKED else cut(out) if name in STORED else out
    return out


def with_(body: str) -> str:
    """DuckDB SQL in which the views named in ``body`` are defined."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for p in _parts(VIEWS[name]):
            add(p)
        done[name] = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])

    for p in _parts(body):
        add(p)
    body = re.sub(r"\{(\w+)\}", r"\1", body)
    views = ",\n".join(f"{n} AS ({s})" for n, s in done.items())
    views = re.sub(r"(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", views)
    recursive = body.lstrip().upper().startswith("RECURSIVE")
    if recursive:
        body = body.lstrip()[len("RECURSIVE") :].lstrip()
    more = recursive or body.lstrip().startswith("--with")
    head = "WITH RECURSIVE " if recursive else "WITH " if views or more else ""
    return head + views + (",\n" if views and more else "\n") + body
