"""Approximate nearest neighbours by a hierarchical k-means tree.

The tree is fitted on a bounded sample and has about as many leaves as the root
of the number of rows; every row is filed under its leaf. Leaves are packed into
tiles of about ``tile_rows`` rows (a larger leaf fills several, by hash), so
neither a large nor a hot leaf is one task's. A query walks the tree best bin
first: a priority queue holds the children of opened nodes by inner product, and
leaves are visited in the order they leave the queue. How many is calibrated:
for some queries the true neighbours are found by brute force, and the number of
leaves is widened until the wanted share of them is reached.

Results come from visited leaves alone. The k-th best of the sampled rows filed
under a query's visited leaves is a lower bound of its k-th best result, so tiles
return only candidates at or above it: nothing is lost by that.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import Sent, bounded, cut

K = 20
#: Bounds of the sample: bytes of its vectors, rows a leaf, and a share of the table.
SAMPLE_BYTES = 64 << 20
SAMPLE_A_LEAF = 32
SAMPLE_SHARE = 4
BRANCHES = 8
MOST_LEAVES = 16_384
LEAF_ROWS = 4
CALIBRATION = 200
RECALL = 0.96
TILE_ROWS = 16_384

FOUND = "query_id bigint, rank int, vec_id bigint, score double, visited int, leaves int, recall double"


class Tree:
    """Hierarchical k-means over a sample; leaves are numbered from 0."""

    def __init__(self, sample: np.ndarray, ids: np.ndarray, branches: int = BRANCHES, leaves: int = 64, leaf_rows: int = LEAF_ROWS, seed: int = 3) -> None:
        self.sample, self.ids, self.rng = sample, ids, np.random.default_rng(seed)
        self.centres, self.children, self.leaf = [np.zeros(sample.shape[1])], [[]], [-1]
        open_ = [(-len(sample), 0, np.arange(len(sample)))]
        n_leaves = 1
        while open_ and n_leaves + branches - 1 <= leaves:  # split the largest node
            size, node, rows = heapq.heappop(open_)
            if -size < 2 * leaf_rows:
                break
            parts = self._split(rows, branches)
            if len(parts) < 2:
                continue
            for part in parts:
                self.children[node].append(len(self.centres))
                heapq.heappush(open_, (-len(part), len(self.centres), part))
                self.centres.append(sample[part].mean(axis=0))
                self.children.append([])
                self.leaf.append(-1)
            n_leaves += len(parts) - 1
        # Leaves are numbered depth first, so that near numbers are near places.
        self.n_leaves, stack = 0, [0]
        while stack:
            node = stack.pop()
            if not self.children[node]:
                self.leaf[node] = self.n_leaves
                self.n_leaves += 1
            stack += self.children[node][::-1]
        self.centres = np.array(self.centres)
        self.filed = np.full(len(sample), -1)
        self.visits, self.recall = self.n_leaves, 1.0

    def _split(self, rows: np.ndarray, k: int) -> list[np.ndarray]:
        points = self.sample[rows]
        distinct = np.unique(points, axis=0)
        centres = distinct[self.rng.choice(len(distinct), min(k, len(distinct)), replace=False)]
        for _ in range(10):
            label = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
            centres = np.array([points[label == j].mean(axis=0) if (label == j).any() else centres[j] for j in range(len(centres))])
        label = (points @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        return [rows[label == j] for j in range(len(centres)) if (label == j).any()]

    def file(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: the nearest child, level by level."""
        node, moving = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while len(moving):
            for at in np.unique(node[moving]).tolist():
                rows = moving[node[moving] == at]
                below = self.children[at]
                if below:
                    c = self.centres[below]
                    node[rows] = np.array(below)[(points[rows] @ c.T - (c**2).sum(axis=1) / 2).argmax(axis=1)]
            moving = np.array([i for i in moving.tolist() if self.children[node[i]]], dtype=np.int64)
        return np.array(self.leaf)[node]

    def walk(self, query: np.ndarray, most: int) -> list[int]:
        """The first ``most`` leaves in best-bin-first order."""
        product = self.centres @ query
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            if not self.children[node]:
                out.append(self.leaf[node])
            for child in self.children[node]:
                heapq.heappush(queue, (-product[child], child))
        return out

    def floor(self, query: np.ndarray, own: int, leaves: list[int], k: int) -> float:
        """The ``k``-th best product of the sampled rows filed under these leaves."""
        known = np.zeros(self.n_leaves + 1, dtype=bool)
        known[leaves] = True
        known[-1] = False  # sampled rows that were not filed
        product = self.sample[known[self.filed] & (self.ids != own)] @ query
        return float(np.partition(product, len(product) - k)[len(product) - k]) if len(product) >= k else -np.inf


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", v.alias("embedding")).filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.filter(~bad & F.exists("embedding", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _best(ids, scores, k):
    """Positions of the k best: larger score, then smaller id."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= edge)
    else:
        near = np.arange(len(scores))
    return near[np.lexsort((ids[near], -scores[near]))[:k]]


def _sampled(part: float) -> Column:
    """Whether a row belongs to the sample of this share, by hash of its id."""
    return F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30)) < int(part * (1 << 30)) + 1


def build(rows: DataFrame, *, leaves: int | None = None, sample: int | None = None, **options) -> tuple[Tree, float] | None:
    """Fit a tree to a sample of the rows, chosen by hash of the id; (tree, share).

    By default about the root of the number of rows as leaves (8 to
    ``MOST_LEAVES``), and ``SAMPLE_A_LEAF`` rows a leaf as sample, but at most one
    row in ``SAMPLE_SHARE`` and ``SAMPLE_BYTES`` of vectors.
    """
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return None
    dimensions, n = sizes[0]
    leaves = leaves or int(min(MOST_LEAVES, max(8, round(n**0.5))))
    sample = sample or min(SAMPLE_A_LEAF * leaves, max(4 * leaves, n // SAMPLE_SHARE))
    part = min(1.0, min(sample, max(1, SAMPLE_BYTES // (8 * dimensions))) / n)
    own = rows.filter(F.size("embedding") == dimensions)
    table = own.filter(_sampled(part)).toArrow().sort_by("vec_id")
    if not len(table):
        table = own.orderBy("vec_id").limit(1).toArrow()
    return Tree(_matrix(table["embedding"]), table["vec_id"].to_numpy(), leaves=leaves, **options), part


def _filer(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.file(_matrix(batch.column(1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(leaf, pa.int32())], ["vec_id", "embedding", "leaf"])

    return run


def _brute(queries):
    """Per batch the best rows for each of a few queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, own, k = queries.value
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, leaf = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            product = q @ _matrix(batch.column(1)).T
            product[own[:, None] == ids[None]] = -np.inf
            for i in range(len(own)):
                best = _best(ids, product[i], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), i, dtype=np.int32)), pa.array(ids[best]), pa.array(leaf[best]), pa.array(product[i][best])], ["q", "vec_id", "leaf", "score"])

    return run


def calibrate(tree: Tree, filed: DataFrame, asked: DataFrame, *, queries: int = CALIBRATION, recall: float = RECALL, k: int = K) -> float:
    """Set ``tree.visits`` to the fewest leaves that reach ``recall``; return the recall.

    The true neighbours of up to ``queries`` rows of ``asked`` (by hash of the id)
    are found among all rows. A recall of 1 visits every leaf, which is exact.
    """
    if recall >= 1:
        tree.visits, tree.recall = tree.n_leaves, 1.0
        return 1.0
    some = asked.select("vec_id", "embedding").orderBy(F.xxhash64("vec_id", F.lit(13)), "vec_id").limit(queries).toArrow()
    if not len(some):
        return 1.0
    q, own = _matrix(some["embedding"]), some["vec_id"].to_numpy()
    sent = filed.sparkSession.sparkContext.broadcast((q, own, k))
    found = filed.mapInArrow(_brute(sent), "q int, vec_id bigint, leaf int, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    true = found.filter("score > double('-inf')").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).select("q", "leaf").toPandas()
    if not len(true):
        return 1.0
    place = [{leaf: i for i, leaf in enumerate(tree.walk(x, tree.n_leaves))} for x in q]
    needed = np.sort([place[i][leaf] + 1 for i, leaf in zip(true["q"], true["leaf"])])
    tree.visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])
    tree.recall = float((needed <= tree.visits).mean())
    return tree.recall


def tiles(counts: dict[int, int], n_leaves: int, tile_rows: int) -> list[tuple[int, int, int]]:
    """(leaf, first tile, number of tiles): neighbouring leaves share a tile of up to
    ``tile_rows`` rows, a larger leaf has tiles of its own."""
    out, tile, held = [], 0, 0
    for leaf in range(n_leaves):
        n = counts.get(leaf, 0)
        if held and held + n > tile_rows:
            tile, held = tile + 1, 0
        parts = max(1, -(-n // tile_rows))
        out.append((leaf, tile, parts))
        tile, held = (tile + parts, 0) if parts > 1 else (tile, held + n)
    return out


VISIT = "query_id bigint, query array<double>, floor double, tile int, leaves array<int>"


def _walker(tree, k, places):
    """Rows (query, tile): the tiles that hold a query's leaves, with these leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, (first, parts) = tree.value, places.value
        for batch in batches:
            for row in range(0, batch.num_rows, 16):
                part = batch.slice(row, 16)
                points, ids = _matrix(part.column(1)), part.column(0).to_numpy()
                own, floors, tile, leaves = [], [], [], []
                for i, (x, q) in enumerate(zip(points, ids.tolist())):
                    visited = sorted(t.walk(x, t.visits))
                    held: dict[int, list] = {}
                    for leaf in visited:
                        for at in range(first[leaf], first[leaf] + parts[leaf]):
                            held.setdefault(at, []).append(leaf)
                    own += [i] * len(held)
                    floors += [t.floor(x, q, visited, k)] * len(held)
                    tile += held
                    leaves += held.values()
                own = pa.array(own, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array(floors, pa.float64()), pa.array(tile, pa.int32()), pa.array(leaves, pa.list_(pa.int32()))],
                    ["query_id", "query", "floor", "tile", "leaves"],
                )

    return run


def _scorer(k):
    def run(_, queries: pa.Table, vectors: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(queries) and len(vectors):
            ids, points = vectors["vec_id"].to_numpy(), _matrix(vectors["embedding"])
            names, leaf = np.unique(vectors["leaf"].to_numpy(), return_inverse=True)
            own, floors, q = queries["query_id"].to_numpy(), queries["floor"].to_numpy(), _matrix(queries["query"])
            leaves = queries["leaves"].to_pylist()
            for low in range(0, len(own), 256):
                product = q[low : low + 256] @ points.T
                for i, row in enumerate(product, low):
                    visited = np.isin(names, leaves[i])[leaf]
                    # A hair below the floor, as products are summed in another order.
                    near = np.flatnonzero(visited & (row >= floors[i] - 1e-9 * (1 + abs(floors[i]))) & (ids != own[i]))
                    # Summed anew in one fixed order, whatever the tile.
                    score = (points[near] * q[i]).sum(axis=1)
                    best = _best(ids[near], score, k)
                    out["query_id"].append(np.full(len(best), own[i]))
                    out["vec_id"].append(ids[near][best])
                    out["score"].append(score[best])
        return pa.table({n: pa.array(np.concatenate(v) if v else np.empty(0), pa.float64() if n == "score" else pa.int64()) for n, v in out.items()})

    return run


def search(vectors: DataFrame, *, every: int = 20, k: int = K, tile_rows: int = TILE_ROWS, recall: float = RECALL, **options) -> DataFrame:
    """The ``k`` nearest found of each row whose ``vec_id`` is divisible by ``every``.

    Nearness is the inner product in double precision; candidates are all rows
    but the query's own id. Returns ``query_id``, ``rank`` (from 1), ``vec_id``,
    ``score``, and how it was found: ``visited`` of ``leaves`` leaves and the
    calibrated ``recall``; equal scores by smaller id. Rows with a null id, and
    vectors that are null, empty, zero, or hold null or non-finite components, or
    are of another length than most, take no part; rows that repeat an id count
    once (the smallest vector); fewer candidates than ``k`` are all returned; an
    empty table, or one without queries, gives no rows. Other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = cut(usable(vectors))
    built = build(rows, **options)
    if built is None:
        return spark.createDataFrame([], FOUND)
    tree, part = built
    rows = rows.filter(F.size("embedding") == tree.sample.shape[1])
    filed = cut(rows.mapInArrow(_filer(Sent(spark, tree)), "vec_id bigint, embedding array<double>, leaf int"))
    asked = filed.filter(F.col("vec_id") % every == 0).select("vec_id", "embedding")
    counts = {r["leaf"]: r["n"] for r in filed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}  # at most MOST_LEAVES rows
    if sum(counts.values()) <= k:
        recall = 1.0  # everything is a result
    calibrate(tree, filed, asked, recall=recall, k=k)
    known = {r["vec_id"]: r["leaf"] for r in filed.filter(_sampled(part)).select("vec_id", "leaf").toLocalIterator()}  # the sample
    tree.filed = np.array([known.get(i, -1) for i in tree.ids.tolist()])
    places = tiles(counts, tree.n_leaves, tile_rows)
    sent = spark.sparkContext.broadcast(([t for _, t, _ in places], [n for _, _, n in places]))
    visits = cut(asked.mapInArrow(_walker(Sent(spark, tree), k, sent), VISIT))
    # A tile that many queries visit meets them part by part; both sides of a part are bounded.
    parts = visits.groupBy("tile").agg(F.ceil(F.count("*") / tile_rows).cast("long").alias("parts"))
    parts = bounded(cut(parts))
    left = visits.join(parts, "tile").withColumn("part", F.pmod(F.xxhash64("query_id"), "parts")).drop("parts")
    at = F.broadcast(spark.createDataFrame(places, "leaf int, first int, n int"))  # at most MOST_LEAVES rows
    right = filed.join(at, "leaf").withColumn("tile", (F.col("first") + F.pmod(F.xxhash64("vec_id"), "n")).cast("int")).drop("first", "n")
    right = right.join(parts, "tile").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    found = left.groupBy("tile", "part").cogroup(right.groupBy("tile", "part")).applyInArrow(_scorer(k), "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score", F.lit(tree.visits).alias("visited"), F.lit(tree.n_leaves).alias("leaves"), F.lit(tree.recall).alias("recall"))


#: The exact search (every leaf visited, scores to nine digits) in DuckDB.
EXACT_ORACLE = r"""
WITH v AS (SELECT vec_id, min(CAST(embedding AS DOUBLE[])) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
           AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY vec_id),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(score, 9) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 20
"""
