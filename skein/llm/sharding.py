"""Sharding through a permutation-filled lookup table.

Every shard prefers the slots of a prime-sized table in the order of its own
permutation ``(offset + j * skip) mod size``. Shards take turns, each claiming
its first free slot, until the table is full. A key's shard is the entry at
``hash(key) mod size``: one look-up. Shards differ by at most one slot, and when
a shard leaves, few keys of the others move.

The table has ``size`` rows whatever the data, which bounds what is broadcast.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: A prime, at least a hundred slots for each of up to 655 shards.
SIZE = 65_537
SHARDS = 64


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}|{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> np.ndarray:
    """For each slot, the position of its shard in ``shards``.

    ``size`` must be prime (then every skip visits every slot) and at least the
    number of shards. Names must differ.
    """
    if len(set(shards)) != len(shards) or not 0 < len(shards) <= size:
        raise ValueError("shards must be distinct, at least one and at most one a slot")
    if size < 2 or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be prime")
    at = [_number(s, "offset") % size for s in shards]
    skip = [_number(s, "skip") % (size - 1) + 1 for s in shards]
    table, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            if not left:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            left -= 1
    return np.array(table)


def slot(key: Column, size: int = SIZE) -> Column:
    """The slot of a key; a null key counts as the empty string."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return (F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: list[str] | int = SHARDS, *, key: str = "doc_id", size: int = SIZE) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of those names are replaced.

    The key is the document, not its source, so a hot source spreads over all
    shards. Equal keys (repeated rows) share a shard; null and empty texts are
    rows like others; an empty table gives no rows.
    """
    names = [f"shard-{k:05d}" for k in range(shards)] if isinstance(shards, int) else list(shards)
    table = lookup_table(names, size)
    rows = docs.sparkSession.createDataFrame([(k, names[s]) for k, s in enumerate(table.tolist())], "_slot int, _shard string")
    others = [c for c in docs.columns if c not in ("slot", "shard")]
    left = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_doc"), slot(F.col(key), size).alias("_slot"))
    out = left.join(F.broadcast(rows), "_slot")
    return out.select(*[F.col("_doc").getField(c).alias(c) for c in others], F.col("_slot").alias("slot"), F.col("_shard").alias("shard"))


def write_shards(placed: DataFrame, path: str, files: int = 1) -> None:
    """One folder a shard, each of ``files`` files (Parquet)."""
    part = F.pmod(F.xxhash64("slot"), F.lit(files))
    placed.repartition(F.col("shard"), part).write.partitionBy("shard").parquet(path)


#: The slots in DuckDB; the table itself is filled turn by turn and has no plain SQL form.
SLOTS_ORACLE = "SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % 65537 AS INTEGER) AS slot FROM documents"
