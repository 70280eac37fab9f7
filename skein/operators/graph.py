"""Graph operators over edge tables (src, dst, weight) and node tables (id)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.session import cut, cut_packed, pack, unpack

from .components import _finish, connected_components


def undirected(edges: DataFrame, *values: str) -> DataFrame:
    """Every edge from both ends."""
    return edges.select("src", "dst", *values).unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *values))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


# Edits -----------------------------------------------------------------------


def add_edges(edges: DataFrame, more: DataFrame, order: str | None = None) -> DataFrame:
    """Edges that are not there yet; of a repeated one the first stays, by the column
    ``order`` or else as the rows of ``more`` stand."""
    rows = more.select("src", "dst", "weight", (F.col(order) if order else F.monotonically_increasing_id()).alias("_order"))
    fresh = rows.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").groupBy("src", "dst").agg(F.min_by("weight", F.struct("_order", "weight")).alias("weight"))
    return edges.unionByName(fresh)


def alter_edges(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """New weights for edges that exist."""
    new = changed.select("src", "dst", F.col("weight").alias("_w"))
    return edges.join(new, ["src", "dst"], "left").select("src", "dst", F.coalesce("_w", "weight").alias("weight"))


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    return edges.join(gone.select("src", "dst"), ["src", "dst"], "left_anti")


def delete_nodes(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Nodes only; their edges stay."""
    return nodes.join(gone.select("id"), "id", "left_anti")


# Degrees -----------------------------------------------------------------------


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In, out and total degree of every node, 0 for isolated ones."""
    ends = edges.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    counts = ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = nodes.select("id").join(counts, "id", "left").select("id", zero("in_degree").alias("in_degree"), zero("out_degree").alias("out_degree"))
    return out.withColumn("degree", F.col("in_degree") + F.col("out_degree"))


def degree_dispersion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Variance to mean ratio of the degrees, and the clustering it suggests."""
    own = degrees(nodes, edges).agg(F.var_pop("degree").alias("v"), F.avg("degree").alias("m"))
    ratio = F.col("v") / F.nullif("m", F.lit(0.0))
    return own.select(F.round(ratio, 6).alias("dispersion"), F.when(ratio >= 4, "HYBRID").otherwise("NCUT").alias("method"))


def singletons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.select("id").join(nodes_of(edges), "id", "left_anti")


def leaves(edges: DataFrame) -> DataFrame:
    """Nodes with one neighbour."""
    return undirected(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).filter("n = 1").select("id")


def incident(edges: DataFrame, node: int) -> DataFrame:
    """Some edge of a node: the least one."""
    return edges.filter((F.col("src") == node) | (F.col("dst") == node)).orderBy("src", "dst").limit(1)


def relabelled(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered 0..n-1 by id, and edges in the new numbers."""
    from .pairs import numbered

    ids = cut(numbered(nodes.select("id"), ["id"], "node"))
    out = edges.join(ids.select(F.col("id").alias("src"), F.col("node").alias("a")), "src").join(ids.select(F.col("id").alias("dst"), F.col("node").alias("b")), "dst")
    return ids, out.select(F.col("a").alias("src"), F.col("b").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


# Components ---------------------------------------------------------------------


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edges as links of its nodes to the least one they reach in it."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _BLOCK:
            yield from (b.rename_columns(["a", "b"]) for b in _finish(held))
            held, n = [], 0
    yield from (b.rename_columns(["a", "b"]) for b in _finish(held))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component) of all nodes; isolated ones are their own.

    Tasks first replace blocks of edges, where they stand, by a link a node.
    """
    ends = edges.select(F.col("src").cast("long").alias("a"), F.col("dst").cast("long").alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    found = connected_components(ends.mapInArrow(_stars, "a bigint, b bigint"))
    return nodes.select("id").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))


def largest_component(labels: DataFrame) -> DataFrame:
    """Nodes of the largest component; ties to the smallest label."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    best = sizes.agg(F.max(F.struct("n", (-F.col("component")).alias("c"))).alias("m")).select((-F.col("m.c")).alias("component"))
    return labels.join(F.broadcast(best), "component", "left_semi").select("id")  # one row


def largest_subgraph(edges: DataFrame) -> DataFrame:
    """Edges of the largest component."""
    labels = cut(components(nodes_of(edges), edges))
    keep = largest_component(labels)
    return edges.join(keep, edges["src"] == keep["id"], "left_semi")


def same_component(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Whether the nodes of each pair (a, b) are connected."""
    left, right = labels.select(F.col("id").alias("a"), F.col("component").alias("ca")), labels.select(F.col("id").alias("b"), F.col("component").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", (F.col("ca") == F.col("cb")).alias("same"))


def size_capped_components(edges: DataFrame, most: int) -> DataFrame:
    """Components that never merge beyond ``most`` nodes, in edge order.

    The order decides, so each connected component is one sequential unit: edges
    are taken by (src, dst) in a grouped map over the plain components.
    """
    import pandas as pd

    labels = cut(components(nodes_of(edges), edges))
    rows = edges.select("src", "dst").join(labels.withColumnRenamed("id", "src"), "src")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parent: dict[int, int] = {}
        size: dict[int, int] = {}

        def root(x: int) -> int:
            parent.setdefault(x, x)
            size.setdefault(x, 1)
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b in pdf.sort_values(["src", "dst"])[["src", "dst"]].itertuples(index=False):
            a, b = root(a), root(b)
            if a != b and size[a] + size[b] <= most:
                a, b = min(a, b), max(a, b)
                parent[b] = a
                size[a] += size[b]
        return pd.DataFrame({"id": list(parent), "component": [root(x) for x in parent]})

    return rows.groupBy("component").applyInPandas(run, "id bigint, component bigint")


# Trees and paths ------------------------------------------------------------------


#: Edges whose forest is found in one task (24 bytes each and as much again for the order).
_BLOCK = 1 << 20


def _forest(src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Places of a minimum spanning forest's edges, by Boruvka rounds over the sorted edges."""
    order = np.lexsort((dst, src, weight))
    ids, where = np.unique(np.concatenate([src[order], dst[order]]), return_inverse=True)
    m = len(order)
    a, b, label, kept, live = where[:m], where[m:], np.arange(len(ids)), np.zeros(m, dtype=bool), np.arange(m)
    while True:
        live = live[label[a[live]] != label[b[live]]]
        if not len(live):
            return order[kept]
        least = np.full(len(ids), m)
        back = live[::-1]  # of several edges of a component the first is written last
        least[label[a[back]]] = back
        other = np.full(len(ids), m)
        other[label[b[back]]] = back
        least = np.unique(np.minimum(least, other))
        least = least[least < m]
        kept[least] = True
        while True:
            x, y = label[a[least]], label[b[least]]
            low = np.minimum(x, y)
            new = np.arange(len(ids))
            np.minimum.at(new, x, low)
            np.minimum.at(new, y, low)
            if (low == np.maximum(x, y)).all():
                break
            while (new[new] != new).any():
                new = new[new]
            label = new[label]


def _local_forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's edges that can be in the whole forest; rows with nulls pass."""
    held, n = [], 0

    def left() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if any(c.null_count for c in table.columns):
            yield from held
        else:
            yield from table.take(pa.array(np.sort(_forest(*(table.column(c).to_numpy() for c in ("src", "dst", "weight")))))).to_batches()

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= _BLOCK:
            yield from left()
            held, n = [], 0
    if n:
        yield from left()


def spanning_forest(edges: DataFrame, rounds: int = 40, block: int = _BLOCK) -> DataFrame:
    """Minimum spanning forest; ties by (weight, src, dst).

    An edge that is not in the forest of some of the edges is not in that of all, so
    tasks first reduce blocks of edges to their forests, in place and then dealt anew,
    until one task can finish. Where that does not shrink them (more nodes than a block's
    edges), Boruvka rounds follow: each round every component takes its least outgoing
    edge; components at least halve, so the rounds are logarithmic.
    """
    edges = edges.select("src", "dst", "weight").filter("src <> dst")
    edges = cut(edges.mapInArrow(_local_forests, edges.schema))
    rows = edges.count()
    while rows > block:
        fewer = cut(edges.repartition(-(-rows // block)).mapInArrow(_local_forests, edges.schema))
        before, rows, edges = rows, fewer.count(), fewer
        if rows > 0.8 * before:
            break
    if rows <= block and edges.filter("src IS NULL OR dst IS NULL OR weight IS NULL").isEmpty():
        return cut(edges.repartition(1).mapInArrow(_local_forests, edges.schema))
    labels = cut(nodes_of(edges).withColumn("component", F.col("id")))
    chosen = edges.limit(0)
    for _ in range(rounds):
        ends = edges.join(labels.select(F.col("id").alias("src"), F.col("component").alias("cs")), "src").join(labels.select(F.col("id").alias("dst"), F.col("component").alias("cd")), "dst")
        across = cut(ends.filter("cs <> cd"))
        if across.isEmpty():
            return chosen
        key = F.struct("weight", "src", "dst").alias("e")
        least = across.select(F.col("cs").alias("c"), key).unionByName(across.select(F.col("cd").alias("c"), key)).groupBy("c").agg(F.min("e").alias("e"))
        picked = cut(least.select("e.src", "e.dst", "e.weight").distinct())
        chosen = cut(chosen.unionByName(picked))
        edges = across.select("src", "dst", "weight")
        joined = connected_components(chosen.select(F.col("src").alias("a"), F.col("dst").alias("b")))
        labels = cut(labels.select("id").join(joined, "id", "left").withColumn("component", F.coalesce("component", "id")))
    raise RuntimeError("too many rounds")


def distances(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """Edges on the shortest path from a node to each reachable one, and the
    smallest predecessor on such a path; with ``most`` only so many edges far.

    Each round stores its frontier only; what was seen is the union of the rounds,
    which is written as one table every ``_ROUNDS`` rounds.
    """
    both = cut(undirected(edges))
    seen = edges.sparkSession.createDataFrame([(source, 0, None)], "id bigint, distance int, previous bigint")
    front, k = seen, 0
    while most is None or k < most:
        k += 1
        step = front.select(F.col("id").alias("src")).join(both, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("previous"))
        front = cut(step.join(seen.select("id"), "id", "left_anti").select("id", F.lit(k).alias("distance"), "previous"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        seen = cut(seen) if k % _ROUNDS == 0 else seen
    return seen


#: Rounds of a search after which its tables become one.
_ROUNDS = 16


def shortest_path(edges: DataFrame, source: int, target: int) -> DataFrame:
    """Nodes of a shortest path: (step, id); no rows if there is none."""
    found = cut(distances(edges, source))
    rows, at = [], target
    while at is not None:
        row = found.filter(F.col("id") == at).first()  # a look-up a step of the path
        if row is None:
            break
        rows.append((row["distance"], at))
        at = row["previous"]
    return edges.sparkSession.createDataFrame(rows, "step int, id bigint")


def anchors(edges: DataFrame) -> DataFrame:
    """(component, id): for each tree of a forest the node left when leaves are peeled
    off, round by round, all trees at once; of two left the smaller."""
    now = cut(edges.select("src", "dst"))
    labels = cut(components(nodes_of(now), now))
    left = cut(labels.select("id"))
    while not now.isEmpty():
        gone = leaves(now)
        kept = cut(now.join(gone, now["src"] == gone["id"], "left_anti").join(gone, now["dst"] == gone["id"], "left_anti"))
        # Of a tree whose last edge goes, both ends stay for the choice.
        inner = left.join(gone, "id", "left_anti")
        last = now.join(gone.withColumnRenamed("id", "src"), "src", "left_semi").join(gone.withColumnRenamed("id", "dst"), "dst", "left_semi")
        left = cut(inner.unionByName(nodes_of(last)))
        now = kept
    return left.join(labels, "id").groupBy("component").agg(F.min("id").alias("id"))


def anchor(edges: DataFrame) -> int | None:
    """The anchor of one tree (of several trees the first one's)."""
    row = anchors(edges).orderBy("component").first()
    return row["id"] if row else None


def composed(edges: DataFrame, roots: DataFrame, value: str, compose, invert, start: Column) -> DataFrame:
    """(id, root, distance, value): a value carried along the trees of a forest.

    ``edges``: (src, dst, value), the value leads from dst to src; ``compose(a, b)``
    continues the value ``a`` at a node with the value ``b`` of the next edge,
    ``invert(b)`` is an edge's value the other way. ``roots``: (id), which get
    ``start``. A round a level, all trees at once.
    """
    there = edges.select("src", "dst", F.col(value).alias("_step"))
    near = cut(there.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), invert(F.col(value)).alias("_step"))))
    seen = roots.select("id", F.col("id").alias("root"), F.lit(0).alias("distance"), start.alias(value))
    front, k = cut(seen), 0
    seen = front
    while True:
        k += 1
        ahead = front.withColumnRenamed("id", "src").join(near, "src").select(F.col("dst").alias("id"), "root", F.lit(k).alias("distance"), compose(F.col(value), F.col("_step")).alias(value))
        front = cut(ahead.join(seen.select("id"), "id", "left_anti"))
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)
        seen = cut(seen) if k % _ROUNDS == 0 else seen


def paths_to(edges: DataFrame, root: int) -> DataFrame:
    """Each node's next node on the way to ``root`` in a tree, with its distance."""
    return distances(edges, root).select("id", F.col("previous").alias("next"), "distance")


# Triangles ---------------------------------------------------------------------------


#: Edges that a task of the triangle search holds about.
_HELD = 500_000
#: Wedges that are looked up at a time.
_WEDGES = 1 << 21


def _closed(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places of the edges (ab, ac, bc) of each triangle a < b < c, piece by piece; u < v.

    Wedges are opened at the end of least (degree, id), which bounds their number by the
    edges times the square root of the edges.
    """
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, m = len(ids), len(u)
    u, v = where[:m], where[m:]
    known = np.argsort(u * n + v)
    keys = (u * n + v)[known]
    rank = np.empty(n, dtype=np.int64)
    rank[np.argsort(np.bincount(where, minlength=n), kind="stable")] = np.arange(n)
    low = rank[u] < rank[v]
    first, other = np.where(low, u, v), np.where(low, v, u)
    order = np.argsort(first, kind="stable")
    first, other = first[order], other[order]
    ahead = np.searchsorted(first, first, side="right") - np.arange(m) - 1  # later edges of the same end
    total = np.concatenate([[0], np.cumsum(ahead)])
    start = 0
    while start < m:
        end = max(start + 1, int(np.searchsorted(total, total[start] + _WEDGES, side="right")) - 1)
        count = ahead[start:end]
        one = np.repeat(np.arange(start, end), count)
        two = one + 1 + np.arange(len(one)) - np.repeat(total[start:end] - total[start], count)
        x, y = other[one], other[two]
        key = np.minimum(x, y) * n + np.maximum(x, y)
        at = np.searchsorted(keys, key)
        hit = keys[np.minimum(at, m - 1)] == key
        sides = np.stack([order[one[hit]], order[two[hit]], known[at[hit]]], axis=1)
        # By (u, v) a triangle's edges stand as ab, ac, bc.
        by = np.argsort(u[sides] * n + v[sides], axis=1)
        yield tuple(np.take_along_axis(sides, by, axis=1).T)
        start = end


def triangles(edges: DataFrame, hold: int = _HELD) -> DataFrame:
    """Each triangle once, a < b < c, with its three edges' values as structs.

    Nodes are dealt into k colours by hash. Each three colours are one task, to which the
    edges between them go (an edge to k tasks), and which lists the triangles of just these
    colours. So edges are shuffled, k times, and wedges never; k follows the number of
    edges, so that a task holds about ``hold`` of them.
    """
    values = [c for c in edges.columns if c not in ("src", "dst")]
    e = edges.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.struct(*values).alias("w") if values else F.lit(None).cast("int").alias("w")).filter("u < v").dropDuplicates(["u", "v"])
    e = cut_packed(e)
    kind = e.schema["w"].dataType.simpleString()

    def run(u, v, w, ab, ac, bc) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(u[ab]), pa.array(v[ab]), pa.array(v[bc]), *(w.take(pa.array(i)) for i in (ab, ac, bc))], ["a", "b", "c", "ab", "ac", "bc"])

    def each(u, v, w, found):
        for ab, ac, bc in found:
            for low in range(0, len(ab), _SENT):
                part = slice(low, low + _SENT)
                yield run(u, v, w, ab[part], ac[part], bc[part])

    return _by_colours(e, hold, each, f"a bigint, b bigint, c bigint, ab {kind}, ac {kind}, bc {kind}")


def _by_colours(e: DataFrame, hold: int, each, schema: str, found=None) -> DataFrame:
    """What ``each`` makes of the triangles of three colours: it gets u, v and w of a task's
    edges and the places of the edges of its triangles. ``e``: (u < v, w), stored. With
    ``found``, a function of u, v and w, the task's edges that it tells are returned instead.

    Edges are packed where they are, so blocks of compressed columns are shuffled.
    """
    n = e.count()
    k = 1 if n <= hold else int(np.ceil(np.sqrt(6 * n / hold)))
    colour = lambda c: F.pmod(F.xxhash64(c), F.lit(k)).cast("int")
    rows = e.withColumn("cu", colour("u")).withColumn("cv", colour("v"))
    rows = rows.withColumn("w", F.col("w").cast(e.schema["w"].dataType.simpleString()))  # as declared: any field may be null

    def blobs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        cu, cv = (table.column(c).to_numpy().astype(np.int64) for c in ("cu", "cv"))
        pair = np.minimum(cu, cv) * k + np.maximum(cu, cv)
        order = np.argsort(pair, kind="stable")
        found, first = np.unique(pair[order], return_index=True)
        table = table.take(pa.array(order))
        for p, low, high in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(order)]):
            yield pa.RecordBatch.from_arrays([pa.array([p // k]), pa.array([p % k]), pa.array([pack(table.slice(low, high - low))], pa.binary())], ["cu", "cv", "blob"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, m = [], 0
        for batch in batches:
            held.append(batch)
            m += batch.num_rows
            if m >= _PACKED:
                yield from blobs(held)
                held, m = [], 0
        if m:
            yield from blobs(held)

    def task(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.concat_tables([unpack(b.as_py()) for batch in batches for b in batch.column("blob")])
        u, v, cu, cv = (table.column(c).to_numpy() for c in ("u", "v", "cu", "cv"))
        wanted, w = key[0].as_py(), table.column("w").combine_chunks()
        if found is not None:
            at = np.flatnonzero(found(u, v, w))
            for low in range(0, len(at), _SENT):
                yield pa.RecordBatch.from_arrays([pa.array(x[at[low : low + _SENT]]) for x in (u, v)], ["src", "dst"])
            return

        def own():
            for ab, ac, bc in _closed(u, v):
                c = np.sort(np.stack([cu[ab], cv[ab], cv[bc]], axis=1).astype(np.int64), axis=1)
                mine = c[:, 0] * k * k + c[:, 1] * k + c[:, 2] == wanted
                yield ab[mine], ac[mine], bc[mine]

        yield from each(u, v, w, own())

    parts = rows.select("u", "v", "w", "cu", "cv").mapInArrow(packed, "cu bigint, cv bigint, blob binary")
    three = F.array_sort(F.array("cu", "cv", F.col("x").cast("long")))
    parts = parts.select("cu", "cv", "blob", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("x"))
    parts = parts.select((three[0] * k * k + three[1] * k + three[2]).alias("t"), "blob")
    return parts.groupBy("t").applyInArrow(task, schema)


#: Edges that a task holds while it packs them.
_PACKED = 1 << 19


def consistent_edges(edges: DataFrame, value: str, error, most: float, hold: int = _HELD) -> DataFrame:
    """``cycle_filter`` where the error is a function of arrays (of the column ``value`` on
    ab, ac and bc): triangles are tested where they are found, and only edges leave the task.
    ``edges`` have src < dst, each once."""
    sides = _by_colours(_valued(edges, value), hold, None, "src bigint, dst bigint", lambda u, v, w: _in_a_loop(u, v, w, np.ones(len(u), dtype=bool), None, error, most))
    return edges.join(sides.distinct(), ["src", "dst"], "left_semi")


def edges_that_close(edges: DataFrame, candidates: DataFrame, value: str, error, most: float, hold: int = _HELD) -> DataFrame:
    """``closing_edges`` where the error is a function of arrays, as in ``consistent_edges``."""
    fresh = candidates.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
    marked = edges.withColumn("_new", F.lit(0)).unionByName(fresh.select(*edges.columns).withColumn("_new", F.lit(1))).dropDuplicates(["src", "dst"])

    def wanted(u, v, w):
        # Of two numbers an edge the second tells candidates.
        w, new = w.field("value"), w.field("fresh").to_numpy() == 1
        return _in_a_loop(u, v, w, new, ~new, error, most)

    kept = marked.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.struct(F.col(value).cast("double").alias("value"), F.col("_new").alias("fresh")).alias("w")).filter("u < v AND w.value IS NOT NULL")
    sides = _by_colours(cut_packed(kept), hold, None, "src bigint, dst bigint", wanted)
    return fresh.join(sides.distinct(), ["src", "dst"], "left_semi")


def _valued(edges: DataFrame, value: str) -> DataFrame:
    return edges.select(F.col("src").alias("u"), F.col("dst").alias("v"), F.col(value).cast("double").alias("w")).filter("u < v AND w IS NOT NULL")


def _in_a_loop(u: np.ndarray, v: np.ndarray, w, asked: np.ndarray, sides: np.ndarray | None, error, most: float) -> np.ndarray:
    """Which edges of ``asked`` are in a triangle with an error below ``most``; u < v, each once.

    Of an edge the neighbours of its end of least degree are tried, some at a time, and no more
    once one has closed; edges that none closes see all. With ``sides`` the triangle's two
    others must be of these; without, the three edges of a triangle are all found by it.
    """
    w = w.to_numpy(zero_copy_only=False)
    ids, where = np.unique(np.concatenate([u, v]), return_inverse=True)
    n, m = len(ids), len(u)
    u, v = where[:m], where[m:]
    side = np.arange(m) if sides is None else np.flatnonzero(sides)
    known = side[np.argsort(u[side] * n + v[side])]
    keys = u[known] * n + v[known]
    ends, others, by = np.concatenate([u[side], v[side]]), np.concatenate([v[side], u[side]]), np.concatenate([side, side])
    order = np.argsort(ends, kind="stable")
    others, by = others[order], by[order]
    first = np.searchsorted(ends[order], np.arange(n + 1))
    degree, good = np.diff(first), np.zeros(m, dtype=bool)
    if not len(keys):
        return good
    left = np.flatnonzero(asked)
    near = np.where(degree[u] <= degree[v], u, v)
    far, low, some = u + v - near, 0, 16
    while len(left := left[~good[left] & (degree[near[left]] > low)]):
        many = np.minimum(degree[near[left]] - low, some)
        total = np.concatenate([[0], np.cumsum(many)])
        start = 0
        while start < len(left):
            end = max(start + 1, int(np.searchsorted(total, total[start] + _WEDGES, side="right")) - 1)
            count = many[start:end]
            e = np.repeat(left[start:end], count)
            at = first[near[e]] + low + np.arange(len(e)) - np.repeat(total[start:end] - total[start], count)
            x, one = others[at], by[at]
            key = np.minimum(x, far[e]) * n + np.maximum(x, far[e])
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[place] == key
            e, x, one, two = e[hit], x[hit], one[hit], known[place[hit]]
            # ``one`` joins x and the near end, ``two`` x and the far end; those of u and of v.
            at_u, at_v = np.where(near[e] == u[e], one, two), np.where(near[e] == u[e], two, one)
            below, above = x < u[e], x > v[e]
            ab = np.where(below, at_u, np.where(above, e, at_u))
            ac = np.where(below, at_v, np.where(above, at_u, e))
            bc = np.where(below, e, at_v)
            mine = error(w[ab], w[ac], w[bc]) < most
            good[e[mine]] = True
            if sides is None:
                good[one[mine]] = good[two[mine]] = True
            start = end
        low, some = low + some, some * 4
    return good & asked


#: Rows of an Arrow batch.
_SENT = 1 << 16


def _sides(p: str, q: str) -> Column:
    """The three edges of a triangle row."""
    return F.array(*[F.struct(F.col(x).alias(p), F.col(y).alias(q)) for x, y in (("a", "b"), ("a", "c"), ("b", "c"))])


def triangle_groups(found: DataFrame) -> DataFrame:
    """Triangles connected through shared edges: (a, b, c, group, size).

    A group is named by its smallest triangle. Triangles are told apart by 64-bit
    hashes of their nodes while they are connected.
    """
    key = F.xxhash64("a", "b", "c")
    rows = cut(found.select("a", "b", "c"))
    sides = rows.select(key.alias("t"), F.explode(_sides("p", "q")).alias("s"))
    sides = cut(sides.select("t", F.col("s.p").alias("p"), F.col("s.q").alias("q")))
    least = sides.groupBy("p", "q").agg(F.min("t").alias("m"))
    links = sides.join(least, ["p", "q"]).select(F.col("t").alias("a"), F.col("m").alias("b"))
    labels = connected_components(links).withColumnRenamed("id", "t")
    rows = cut(rows.withColumn("t", key).join(labels, "t"))
    groups = rows.groupBy("component").agg(F.min(F.struct("a", "b", "c")).alias("first"), F.count("*").alias("size"))
    return rows.join(groups, "component").select("a", "b", "c", F.concat_ws("-", "first.a", "first.b", "first.c").alias("group"), "size")


def open_wedges(edges: DataFrame) -> DataFrame:
    """Pairs with a common neighbour but no edge: (a, b, via)."""
    both = undirected(edges).distinct()
    ends = both.select(F.col("src").alias("via"), F.col("dst").alias("a")).join(both.select(F.col("src").alias("via"), F.col("dst").alias("b")), "via").filter("a < b")
    return ends.join(both.select(F.col("src").alias("a"), F.col("dst").alias("b")), ["a", "b"], "left_anti")


def closing_edges(edges: DataFrame, candidates: DataFrame, error: Column, most: float) -> DataFrame:
    """Candidate edges that close an open wedge with a loop error below ``most``.

    ``edges`` and ``candidates`` have src < dst and the same columns; ``error`` is an
    expression over structs ab, ac and bc, as in ``cycle_filter``. A candidate must be
    consistent with at least one pair of edges that it closes.
    """
    values = [c for c in edges.columns if c not in ("src", "dst")]
    fresh = candidates.join(edges.select("src", "dst"), ["src", "dst"], "left_anti").dropDuplicates(["src", "dst"])
    marked = edges.withColumn("_new", F.lit(False)).unionByName(fresh.select(*edges.columns).withColumn("_new", F.lit(True)))
    found = triangles(marked.select("src", "dst", *values, "_new"))
    one = [F.col(f"{k}._new").cast("int") for k in ("ab", "ac", "bc")]
    good = found.filter((one[0] + one[1] + one[2] == 1) & (error < most))
    side = F.when(F.col("ab._new"), F.struct(F.col("a").alias("src"), F.col("b").alias("dst"))).when(F.col("ac._new"), F.struct(F.col("a").alias("src"), F.col("c").alias("dst")))
    side = side.otherwise(F.struct(F.col("b").alias("src"), F.col("c").alias("dst")))
    return fresh.join(good.select(side.alias("s")).select("s.*").distinct(), ["src", "dst"], "left_semi")


def component_pairs(edges: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """The heaviest ``most`` edges between each two components: (c1, c2, src, dst, weight, rank)."""
    at = lambda end, c: labels.select(F.col("id").alias(end), F.col("component").alias(c))
    rows = edges.select("src", "dst", "weight").join(at("src", "_a"), "src").join(at("dst", "_b"), "dst").filter("_a <> _b")
    rows = rows.select(F.least("_a", "_b").alias("c1"), F.greatest("_a", "_b").alias("c2"), "src", "dst", "weight")
    order = Window.partitionBy("c1", "c2").orderBy(F.desc("weight"), "src", "dst")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _verified_without_budget(edges: DataFrame, verify) -> DataFrame:
    """``verified_forest`` where no component can use its budget up.

    Each round takes the maximum forest of what has not failed and verifies all of its
    untried edges together; once all have passed, no edge outside it can be in the
    forest of those that pass. ``edges`` are stored and stay as they are: what has failed
    is at most a forest a round.
    """
    passed = failed = cut(edges.limit(0))
    while True:
        left = edges.join(failed.select("src", "dst"), ["src", "dst"], "left_anti")
        found = spanning_forest(left.select("src", "dst", (-F.col("weight")).alias("weight")))
        forest = cut(found.select("src", "dst", (-F.col("weight")).alias("weight")))
        asked = cut(forest.join(passed.select("src", "dst"), ["src", "dst"], "left_anti"))
        if asked.isEmpty():
            return forest
        good = cut(verify(asked).select("src", "dst", "weight"))
        passed = cut(passed.unionByName(good))
        failed = cut(failed.unionByName(asked.join(good.select("src", "dst"), ["src", "dst"], "left_anti")))


def verified_forest(edges: DataFrame, verify, budget: int = 3) -> DataFrame:
    """A maximum spanning forest of edges that pass ``verify`` (edges -> those that pass).

    Rounds: every component proposes its heaviest untried outgoing edge, proposals are
    verified together, and those that pass join components. Edges that fail are not
    tried again; a component that has had ``budget`` failures in a row proposes no
    more until it is joined by another.
    """
    left = cut(edges.select("src", "dst", "weight").filter("src <> dst"))
    if budget >= left.count():
        return _verified_without_budget(left, verify)
    state = cut(nodes_of(left).select("id", F.col("id").alias("component"), F.lit(0).cast("long").alias("failed")))
    chosen = left.limit(0)
    while True:
        at = lambda end, c, f: state.select(F.col("id").alias(end), F.col("component").alias(c), F.col("failed").alias(f))  # noqa: B023, E731
        across = left.join(at("src", "cs", "fs"), "src").join(at("dst", "cd", "fd"), "dst").filter("cs <> cd")
        key = F.struct((-F.col("weight")).alias("w"), "src", "dst")
        asks = across.filter(F.col("fs") < budget).select(F.col("cs").alias("c"), key.alias("e")).unionByName(across.filter(F.col("fd") < budget).select(F.col("cd").alias("c"), key.alias("e")))
        least = cut(asks.groupBy("c").agg(F.min("e").alias("e")))
        if least.isEmpty():
            return chosen
        asked = cut(least.select("e.src", "e.dst", (-F.col("e.w")).alias("weight")).distinct())
        passed = cut(verify(asked).select("src", "dst", "weight"))
        chosen = cut(chosen.unionByName(passed))
        left = cut(left.join(asked.select("src", "dst"), ["src", "dst"], "left_anti"))
        joined = connected_components(chosen.select(F.col("src").alias("a"), F.col("dst").alias("b"))).withColumnRenamed("component", "now")
        failed = least.join(passed.select(F.struct((-F.col("weight")).alias("w"), "src", "dst").alias("e"), F.lit(0).alias("good")), "e", "left")
        failed = failed.select(F.col("c").alias("component"), F.col("good").isNull().cast("long").alias("more"))
        fresh = state.join(joined, "id", "left").withColumn("now", F.coalesce("now", "id")).join(failed, "component", "left")
        # Joined components begin anew.
        state = cut(fresh.select("id", F.col("now").alias("component"), F.when(F.col("now") != F.col("component"), F.lit(0)).otherwise(F.col("failed") + F.coalesce("more", F.lit(0))).cast("long").alias("failed")))


def reinforced(edges: DataFrame, candidates: DataFrame, turns: DataFrame, labels: DataFrame, most: int, most_degrees: float) -> DataFrame:
    """``edges`` and the candidates that agree with them: of those inside a component
    the ones whose turn agrees with the path through the tree (``turns``: id, turn),
    of those between components the ``most`` heaviest of each two."""
    fresh = candidates.join(edges.select("src", "dst"), ["src", "dst"], "left_anti")
    at = lambda end, c: labels.select(F.col("id").alias(end), F.col("component").alias(c))
    inside = fresh.join(at("src", "_a"), "src").join(at("dst", "_b"), "dst").filter("_a = _b").select(*fresh.columns)
    agreeing = orientation_filter(inside, turns, most_degrees)
    bridges = fresh.join(component_pairs(fresh, labels, most).select("src", "dst"), ["src", "dst"], "left_semi")
    return edges.unionByName(agreeing.select(*edges.columns)).unionByName(bridges.select(*edges.columns))


def cycle_filter(edges: DataFrame, found: DataFrame, error: Column, most: float) -> DataFrame:
    """Edges in at least one triangle whose loop error is below ``most``.

    ``error`` is an expression over a triangle row's structs ab, ac and bc.
    """
    good = found.filter(error < most)
    sides = good.select(F.explode(_sides("src", "dst")).alias("s")).select("s.src", "s.dst").distinct()
    return edges.join(sides, ["src", "dst"], "left_semi")


def orientation_filter(edges: DataFrame, rotations: DataFrame, most_degrees: float) -> DataFrame:
    """Edges whose relative turn agrees with the global ones; both ends needed."""
    left, right = rotations.select(F.col("id").alias("src"), F.col("turn").alias("ts")), rotations.select(F.col("id").alias("dst"), F.col("turn").alias("td"))
    rows = edges.join(left, "src", "left").join(right, "dst", "left")
    off = F.pmod(F.col("td") - F.col("ts") - F.col("turn") + 180, F.lit(360.0)) - 180
    return rows.filter(F.col("ts").isNotNull() & F.col("td").isNotNull() & (F.abs(off) <= most_degrees)).select(*edges.columns)


# Cuts ------------------------------------------------------------------------------------


def cut_values(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Per label: inner weight, cut weight and their share of the normalised cut."""
    left, right = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    rows = edges.join(left, "src").join(right, "dst")
    ends = rows.select(F.col("ls").alias("label"), "weight", (F.col("ls") != F.col("ld")).alias("cut")).unionByName(rows.select(F.col("ld").alias("label"), "weight", (F.col("ls") != F.col("ld")).alias("cut")))
    own = ends.groupBy("label").agg(F.sum("weight").alias("volume"), F.sum(F.when(F.col("cut"), F.col("weight")).otherwise(0)).alias("cut"))
    return own.withColumn("share", F.round(F.col("cut") / F.nullif("volume", F.lit(0)), 6))
