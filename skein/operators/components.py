"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.session import cut

#: So few edges (16 bytes each) are finished in one task; a fixed bound.
SMALL = 100_000


def connected_components(edges: DataFrame, *, rounds: int = 60, small: int = SMALL) -> DataFrame:
    """(id, component): the smallest id reachable from each endpoint.

    Alternates the large-star and small-star steps: every node links its larger
    neighbours, then its smaller ones, to the least node it knows. Each step is
    a grouped minimum and an equi-join, so hubs are shared out by the join and
    never gathered; the number of rounds is logarithmic in practice. Once at most
    ``small`` edges are there, one task finishes them. Columns ``a`` and ``b``;
    null endpoints are ignored, self-loops make single nodes.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    # From here on a >= b in every edge.
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= small:
        return now.repartition(1).mapInArrow(_finish, "id bigint, component bigint")
    loops, now, seen = now.filter("a = b").select("a"), now.filter("a > b"), None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        # Small star: a links itself and its smaller neighbours to the least one.
        large = large.unionByName(now.join(least, "a").select("a", F.col("m").alias("b")).filter("a <> b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        made = large.join(smallest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        made = made.unionByName(smallest.select("a", F.col("m").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        now = cut(made.distinct())
        state = now.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        if state[0] <= small:
            done = now.repartition(1).mapInArrow(_finish, "id bigint, component bigint")
            now = cut(done.select(F.col("id").alias("a"), F.col("component").alias("b")).filter("a <> b"))
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    labelled = now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    return labelled.unionByName(loops.select(F.col("a").alias("id"), F.col("a").alias("component")).join(labelled, "id", "left_anti"))


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of a bounded number of edges, by hooking and pointer jumping."""
    rows = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not rows:
        return
    a, b = (np.concatenate(x) for x in zip(*rows))
    ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = where[: len(a)], where[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for ends in (label[a], label[b]):
            np.minimum.at(new, ends, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[label])], ["id", "component"])
