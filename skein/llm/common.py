"""Helpers shared by the training-data operators.

Word splitting works on UTF-8 bytes: both word classes used here are unions of
ASCII ranges and "everything at or above 0x80", so a byte-level split equals a
code-point-level split.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F

from skein.session import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: Fixed odd multiplier of the rolling word hash and its inverse mod 2**64.
_R = 0x9E3779B97F4A7C13
_RINV = pow(_R, -1, 1 << 64)
#: Bytes hashed at once; longer buffers are cut at white space.
_PIECE = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table of ``sf_dir`` (any file system Spark can read)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Sent:
    """A broadcast object of this package's classes, carried by value.

    Plain broadcasts name the class of what they hold, which executors without
    the package could not find.
    """

    def __init__(self, spark: SparkSession, value) -> None:
        self._bytes = spark.sparkContext.broadcast(cloudpickle.dumps(value))
        self._value = None

    def __getstate__(self):
        return {"_bytes": self._bytes, "_value": None}

    @property
    def value(self):
        if self._value is None:
            self._value = cloudpickle.loads(self._bytes.value)
        return self._value

    def unpersist(self) -> None:
        self._bytes.unpersist()


def discard(spark: SparkSession, path: str) -> None:
    """Delete a path made by ``scratch``."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def bounded(df: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """Broadcast a stored table of a few numbers a row if it has at most ``rows``.

    Beyond that bound the join shuffles both sides.
    """
    return F.broadcast(df) if df.count() <= rows else df


#: Keys that are met by a broadcast at most; every other key has fewer than a
#: ``HOT``-th of the rows.
HOT = 100_000


def by_key(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join with a stored ``table`` of one row a key.

    ``count`` is the number of ``rows`` of the key, ``total`` that of all; both only
    choose the plan. Up to ``HOT`` keys are broadcast. Of more, the frequent ones
    are (at most ``HOT`` can have a ``HOT``-th of the rows each), and only the
    others, of which none is large, are joined by a shuffle.
    """
    others = [c for c in table.columns if c not in (key, count)]
    if table.count() <= HOT:
        return rows.join(F.broadcast(table.drop(count)), key).select(*rows.columns, *others)
    frequent = F.col(count) * HOT >= total
    hot = table.filter(frequent).select(key, F.struct(*others).alias("_known"))
    both = rows.join(F.broadcast(hot), key, "left")
    first = both.filter("_known IS NOT NULL").select(*rows.columns, "_known.*")
    rest = both.filter("_known IS NULL").select(*rows.columns).join(table.filter(~frequent).drop(count), key)
    return first.unionByName(rest.select(*rows.columns, *others))


def _byte_table(is_word) -> bytes:
    out = bytearray()
    for b in range(256):
        if 0x41 <= b <= 0x5A:
            b += 0x20
        out.append(b if is_word(b) else 0x20)
    return bytes(out)


#: Lower-case A-Z; everything that is not a letter, a digit or >= 0x80 becomes a blank.
ALNUM = _byte_table(lambda b: b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: Lower-case A-Z; 0x20 and 0x09-0x0D become a blank.
NONBLANK = _byte_table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (splitmix64 constants)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class WordHasher:
    """64-bit hashes of the words of a byte buffer, vectorised."""

    def __init__(self) -> None:
        self.chars = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_R))
        self.up = self.down = np.empty(0, dtype=np.uint64)

    def __call__(self, buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, hash) of each blank-separated word of ``buf``."""
        parts, at = [], 0
        while at < len(buf):
            end = min(len(buf), at + _PIECE)
            if end < len(buf):
                end = buf.find(b" ", end)
                end = len(buf) if end < 0 else end
            s, e, h = self._piece(np.frombuffer(buf, dtype=np.uint8, count=end - at, offset=at))
            parts.append((s + at, e + at, h))
            at = end
        if not parts:
            none = np.empty(0, dtype=np.int64)
            return none, none, np.empty(0, dtype=np.uint64)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def _piece(self, arr: np.ndarray):
        n = len(arr)
        if len(self.up) < n:
            self.up, self.down = _powers(_R, max(n, _PIECE)), _powers(_RINV, max(n, _PIECE))
        edge = np.diff((arr != 32).astype(np.int8), prepend=0, append=0)
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        total = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(self.chars[arr] * self.up[:n], out=total[1:])
        h = (total[e] - total[s]) * self.down[s]
        return s, e, mix64(h ^ (e - s).astype(np.uint64))


def shingle_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive word hashes."""
    n = len(words) - k + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_R) + words[i : i + n]
    return mix64(out)


def text_groups(column, limit: int = 1 << 20):
    """Cut an Arrow string column into runs of rows of about ``limit`` bytes.

    Yields (first row, list of UTF-8 bytes); null is empty.
    """
    import pyarrow as pa

    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    first, held, size = 0, [], 0
    for i in range(len(column)):
        value = column[i].as_buffer()
        value = b"" if value is None else value.to_pybytes()
        held.append(value)
        size += len(value)
        if size >= limit:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def joined(texts: list[bytes], table: bytes) -> tuple[bytes, np.ndarray]:
    """Texts as one translated buffer, blank between them, and each text's offset."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    return b" ".join(texts).translate(table), np.concatenate([[0], ends[:-1]]).astype(np.int64)
