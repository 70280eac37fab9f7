"""Partitioning a weighted graph into overlapping clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from skein.session import cut, cut_packed, pack, unpack

from .graph import components, nodes_of, undirected

METHODS = ("NCUT", "KMEANS", "SPECTRAL", "HYBRID", "COMMUNITY_DETECTION")
ALIASES = {"SPECTRA": "SPECTRAL", "COMMUNITY": "COMMUNITY_DETECTION"}


def method(name: str | None) -> str:
    """A known method's name; anything else is NCUT."""
    name = (name or "").upper()
    name = ALIASES.get(name, name)
    return name if name in METHODS else "NCUT"


# Dense kernels: one connected component of bounded size ------------------------------


def laplacian(n: int, rows, cols, weights, *, normalised: bool = True) -> np.ndarray:
    w = np.zeros((n, n))
    np.add.at(w, (rows, cols), weights)
    np.add.at(w, (cols, rows), weights)
    d = w.sum(axis=1)
    if not normalised:
        return np.diag(d) - w
    k = 1 / np.sqrt(np.where(d > 0, d, 1))
    return np.eye(n) - k[:, None] * w * k[None]


def kmeans(points: np.ndarray, k: int, rounds: int = 50, seed: int = 0) -> np.ndarray:
    """Lloyd's algorithm from k-means++ centres."""
    rng = np.random.default_rng(seed)
    centres, d = [points[rng.integers(len(points))]], np.inf
    for _ in range(1, k):
        d = np.minimum(d, ((points - centres[-1]) ** 2).sum(axis=1))
        centres.append(points[rng.choice(len(points), p=d / d.sum()) if d.sum() > 0 else rng.integers(len(points))])
    centres, label = np.array(centres), None
    for _ in range(rounds):
        new = np.stack([((points - c) ** 2).sum(axis=1) for c in centres], axis=1).argmin(axis=1)  # one centre's differences at a time
        if label is not None and (new == label).all():
            break
        label = new
        for j in range(k):
            if (label == j).any():
                centres[j] = points[label == j].mean(axis=0)
    return label


def spectral(n: int, rows, cols, weights, k: int, seed: int = 0) -> np.ndarray:
    """Labels from the k smallest eigenvectors of the weighted Laplacian."""
    _, vectors = np.linalg.eigh(laplacian(n, rows, cols, weights))
    points = vectors[:, :k]
    points = points / np.maximum(np.linalg.norm(points, axis=1, keepdims=True), 1e-12)
    return kmeans(points, k, seed=seed)


def normalised_cut(n: int, rows, cols, weights, k: int) -> np.ndarray:
    """Recursive bisection by the second eigenvector, largest part first, then
    moves of single nodes that lower the cut while keeping parts balanced."""
    w = np.zeros((n, n))
    np.add.at(w, (rows, cols), weights)
    np.add.at(w, (cols, rows), weights)
    label = np.zeros(n, dtype=np.int64)
    for new in range(1, k):
        part = np.flatnonzero(label == np.bincount(label).argmax())
        if len(part) < 2:
            break
        own = w[np.ix_(part, part)]
        d = np.maximum(own.sum(axis=1), 1e-12)
        _, vectors = np.linalg.eigh(np.eye(len(part)) - own / np.sqrt(d[:, None] * d[None]))
        order = np.argsort(vectors[:, min(1, len(part) - 1)] / np.sqrt(d), kind="stable")
        label[part[order[len(part) // 2 :]]] = new
    most = int(np.ceil(1.1 * n / k))
    gain, sizes, all_ = np.stack([w[:, label == j].sum(axis=1) for j in range(k)], axis=1), np.bincount(label, minlength=k), np.arange(n)
    best, own = gain.argmax(axis=1), gain[all_, label]
    better = gain[all_, best] > own
    for _ in range(10):
        moved, i = False, -1
        # Nodes in turn; those between two moves stay, so the next to move is looked up.
        while len(after := np.flatnonzero(better[i + 1 :])):
            free = (sizes[best[i + 1 + after]] < most) & (sizes[label[i + 1 + after]] > 1)
            if not free.any():
                break
            i += 1 + int(after[free.argmax()])
            old, new, moved = label[i], best[i], True
            label[i] = new
            sizes[old], sizes[new] = sizes[old] - 1, sizes[new] + 1
            gain[:, old] -= w[i]
            gain[:, new] += w[i]
            best = gain.argmax(axis=1)
            better = gain[all_, best] > gain[all_, label]
        if not moved:
            break
    return label


def greedy_modularity(n: int, rows, cols, weights) -> np.ndarray:
    """Communities by merging the pair with the best gain until none gains."""
    total = float(np.sum(weights))
    w, linked, degree = np.zeros((n, n)), np.zeros((n, n), dtype=bool), np.zeros(n)
    rows, cols, weights = np.asarray(rows), np.asarray(cols), np.asarray(weights, dtype=float)
    np.add.at(degree, np.stack([rows, cols], axis=1).ravel(), np.repeat(weights, 2))
    far = rows != cols
    np.add.at(w, (rows[far], cols[far]), weights[far])
    np.add.at(w, (cols[far], rows[far]), weights[far])
    linked[rows[far], cols[far]] = linked[cols[far], rows[far]] = True
    label = np.arange(n)
    if total <= 0:
        return label
    worth = lambda i: np.where(linked[i], w[i] / total - degree[i] * degree / (2 * total * total), -np.inf)
    # Of each pair the entry above the diagonal counts: the first of the largest is that of the least ids.
    gain = np.full((n, n), -np.inf)
    for i in range(n):
        gain[i, i + 1 :] = worth(i)[i + 1 :]
    while n > 1:
        i, j = np.unravel_index(gain.argmax(), gain.shape)
        if gain[i, j] <= 0:
            break
        w[i] += w[j]
        w[:, i] = w[i]
        linked[i] |= linked[j]
        linked[i, i] = False
        linked[:, i] = linked[i]
        linked[j] = linked[:, j] = False
        w[j] = w[:, j] = 0
        degree[i] += degree[j]
        now = worth(i)
        gain[i, i + 1 :], gain[:i, i] = now[i + 1 :], now[:i]
        gain[j] = gain[:, j] = -np.inf
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def min_cut(n: int, rows, cols, weights) -> tuple[float, np.ndarray]:
    """Global minimum cut by maximum adjacency search and contraction."""
    w = np.zeros((n, n))
    np.add.at(w, (rows, cols), weights)
    np.add.at(w, (cols, rows), weights)
    np.fill_diagonal(w, 0)
    groups = [[i] for i in range(n)]
    alive = list(range(n))
    best, side = np.inf, np.zeros(n, dtype=bool)
    while len(alive) > 1:
        pull = {i: w[alive[0], i] for i in alive[1:]}
        order = [alive[0]]
        while pull:
            i = max(pull, key=lambda x: (pull[x], -x))
            last = pull.pop(i)
            order.append(i)
            for j in pull:
                pull[j] += w[i, j]
        s, t = order[-2], order[-1]
        if last < best:
            best, side = float(last), np.zeros(n, dtype=bool)
            side[groups[t]] = True
        groups[s] += groups[t]
        w[s] += w[t]
        w[:, s] += w[:, t]
        w[s, s] = 0
        alive.remove(t)
    return best, side


def max_flow(n: int, rows, cols, capacities, source: int, sink: int) -> tuple[float, np.ndarray]:
    """Maximum flow along shortest paths; the source side of a minimum cut."""
    residual: list[dict[int, float]] = [{} for _ in range(n)]
    for i, j, c in zip(rows, cols, capacities):
        residual[i][j] = residual[i].get(j, 0.0) + c
        residual[j].setdefault(i, 0.0)
    flow = 0.0
    while True:
        previous, queue = {source: None}, [source]
        for i in queue:
            if sink in previous:
                break
            for j, c in residual[i].items():
                if c > 1e-12 and j not in previous:
                    previous[j] = i
                    queue.append(j)
        if sink not in previous:
            return flow, np.array([i in previous for i in range(n)])
        path, j = [], sink
        while previous[j] is not None:
            path.append((previous[j], j))
            j = previous[j]
        step = min(residual[i][j] for i, j in path)
        for i, j in path:
            residual[i][j] -= step
            residual[j][i] += step
        flow += step


def labels_of(rows, cols, weights, k: int, name: str) -> np.ndarray:
    """Labels of the nodes 0..n-1 of one graph by a method's name."""
    n = int(max(np.max(rows), np.max(cols))) + 1
    name = method(name)
    if name == "COMMUNITY_DETECTION":
        return greedy_modularity(n, rows, cols, weights)
    if name == "SPECTRAL":
        return spectral(n, rows, cols, weights, k)
    if name == "KMEANS":
        return kmeans(laplacian(n, rows, cols, weights), k)
    if name == "HYBRID":  # communities, then cuts inside those above their share
        label, out, at = greedy_modularity(n, rows, cols, weights), np.zeros(n, dtype=np.int64), 0
        for c in range(label.max() + 1):
            own = np.flatnonzero(label == c)
            parts = max(1, round(len(own) * k / n))
            inner = np.isin(rows, own) & np.isin(cols, own)
            sub = normalised_cut(len(own), np.searchsorted(own, rows[inner]), np.searchsorted(own, cols[inner]), weights[inner], parts) if parts > 1 else np.zeros(len(own), dtype=np.int64)
            out[own] = at + sub
            at += sub.max() + 1
        return out
    return normalised_cut(n, rows, cols, weights, k)


# Distributed form ---------------------------------------------------------------------


#: Nodes up to which a component is cut as one dense matrix (32 MB of doubles); larger
#: components are broken up by label propagation first.
DENSE = 2_000


def assign(edges: DataFrame, size: int, name: str = "NCUT", *, most: int | None = None) -> DataFrame:
    """(id, label): clusters of about ``size`` nodes.

    Components are cut apart from each other. One of up to ``most`` nodes (``DENSE`` by
    default) is cut by a dense kernel in a grouped map; larger ones are first broken up by rounds of
    weighted label propagation over the whole edge table, whose blocks are capped
    in size, and the blocks are cut instead. No task ever holds more than a block.
    """
    most = most or DENSE
    edges = cut_packed(edges.select("src", "dst", "weight"))
    labels = cut(components(nodes_of(edges), edges))
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    blocks = labels.join(sizes, "component").select("id", F.col("component").alias("block"), "n")
    if not sizes.filter(F.col("n") > most).isEmpty():
        blocks = _propagated(edges, blocks, most)
    blocks = cut(blocks.select("id", "block"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, weights = _edges_of(pdf["blob"])
        ids = np.unique(np.concatenate([src, dst]))
        k = max(1, len(ids) // size)
        rows, cols = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        label = labels_of(rows, cols, weights, k, name) if k > 1 or method(name) == "COMMUNITY_DETECTION" else np.zeros(len(ids), dtype=np.int64)
        least = pd.Series(ids).groupby(label).transform("min")
        return pd.DataFrame({"id": ids, "label": least.to_numpy()})

    found = _inside(edges, blocks).groupBy("block").applyInPandas(run, "id bigint, label bigint")
    return labels.select("id").join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


#: Nodes whose labels are sent to the edges; beyond, the edges are shuffled to the labels.
_KNOWN = 100_000


def _labelled(labels: DataFrame) -> DataFrame:
    """The labels of nodes as the side of a join that edges meet where they are, if few."""
    return F.broadcast(labels) if labels.limit(_KNOWN + 1).count() <= _KNOWN else labels


def _inside(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(block, blob): the edges inside each block (``blocks``: id, block), packed where they
    are before they are shuffled."""
    known = _labelled(blocks)
    rows = edges.join(known.select(F.col("id").alias("src"), F.col("block").alias("b1")), "src").join(known.select(F.col("id").alias("dst"), F.col("block").alias("b2")), "dst")
    rows = rows.filter("b1 = b2").select(F.col("b1").alias("block"), "src", "dst", F.col("weight").cast("double").alias("weight"))

    def blobs(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        block = table.column(0).to_numpy()
        order = np.argsort(block, kind="stable")
        found, first = np.unique(block[order], return_index=True)
        table = table.select(["src", "dst", "weight"]).take(pa.array(order))
        sides = list(zip(first.tolist(), [*first[1:].tolist(), len(order)]))
        # Of few edges the plain numbers are shorter, behind a zero.
        plain = lambda t: b"\0" + b"".join(t.column(c).to_numpy().astype(k).tobytes() for c, k in (("src", "<i8"), ("dst", "<i8"), ("weight", "<f8")))
        each = [(pack if high - low > 64 else plain)(table.slice(low, high - low)) for low, high in sides]
        for low in range(0, len(each), 1_000):
            yield pa.RecordBatch.from_arrays([pa.array(found[low : low + 1_000]), pa.array(each[low : low + 1_000], pa.binary())], ["block", "blob"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= _PIECE:
                yield from blobs(held)
                held, n = [], 0
        if n:
            yield from blobs(held)

    return rows.mapInArrow(packed, "block bigint, blob binary")


#: Edges that a task holds while it packs them.
_PIECE = 1 << 18


def _edges_of(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """src, dst and weight of packed edges, by (src, dst)."""
    parts = []
    for blob in blobs:
        if blob[:1] == b"\0":
            n = len(blob) // 24
            parts.append([np.frombuffer(blob, k, n, 1 + 8 * i * n) for i, k in enumerate(("<i8", "<i8", "<f8"))])
        else:
            table = unpack(blob)
            parts.append([table.column(c).to_numpy() for c in ("src", "dst", "weight")])
    src, dst, weight = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((dst, src))
    return src[order], dst[order], weight[order].astype(float)


def _propagated(edges: DataFrame, blocks: DataFrame, most: int, rounds: int = 8) -> DataFrame:
    """Blocks of at most ``most`` nodes inside components that are larger."""
    large = cut(blocks.filter(F.col("n") > most).select("id"))
    both = cut(undirected(edges, "weight").join(large.select(F.col("id").alias("src")), "src", "left_semi"))
    now = cut(large.withColumn("block", F.col("id")))
    for _ in range(rounds):
        votes = both.join(now.select(F.col("id").alias("src"), "block"), "src").groupBy(F.col("dst").alias("id"), "block").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("id").agg(F.max(F.struct("w", (-F.col("block")).alias("b"))).alias("m"))
        wanted = now.join(best, "id", "left").select("id", F.col("block").alias("old"), F.coalesce(-F.col("m.b"), F.col("block")).alias("block"), F.coalesce("m.w", F.lit(0)).alias("w"))
        place = Window.partitionBy("block").orderBy(F.desc("w"), "id")
        now = cut(wanted.withColumn("_r", F.row_number().over(place)).select("id", F.when(F.col("_r") <= most // 2, F.col("block")).otherwise(F.col("old")).alias("block")))
    capped = Window.partitionBy("block").orderBy("id")
    part = F.floor((F.row_number().over(capped) - 1) / F.lit(most))
    now = now.withColumn("part", part).withColumn("block", F.min("id").over(Window.partitionBy("block", "part"))).select("id", "block", F.lit(0).cast("long").alias("n"))
    return blocks.filter(F.col("n") <= most).unionByName(now)


def split_edges(edges: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges inside clusters (with label), and lost ones (with l1 < l2)."""
    labels = _labelled(labels)
    left, right = labels.select(F.col("id").alias("src"), F.col("label").alias("ls")), labels.select(F.col("id").alias("dst"), F.col("label").alias("ld"))
    rows = edges.join(left, "src").join(right, "dst")
    inner = rows.filter("ls = ld").select(F.col("ls").alias("label"), "src", "dst", "weight")
    lost = rows.filter("ls <> ld").select(F.least("ls", "ld").alias("l1"), F.greatest("ls", "ld").alias("l2"), "src", "dst", "weight")
    return inner, lost


def boundary_edges(lost: DataFrame) -> DataFrame:
    """Lost edges of each two clusters, heaviest first: ``rank`` from 1, ties by ids."""
    order = Window.partitionBy("l1", "l2").orderBy(F.desc("weight"), "src", "dst")
    return lost.withColumn("rank", F.row_number().over(order))


class _Given:
    """What two clusters, which begin with ``n1`` and ``n2`` nodes, give each other."""

    def __init__(self, n1: int, n2: int, completeness: float, overlap: int):
        self.size, self.added, self.common, self.done = [n1, n2], (set(), set()), 0, False
        self.completeness, self.overlap = completeness, overlap

    def take(self, src: list[int], dst: list[int], first: list[bool]) -> list[tuple[int, int]]:
        """(0 or 1 for the cluster, node) added by the next edges; ``first``: src is in the first one."""
        out, size, added = [], self.size, self.added
        for s, d, f in zip(src, dst, first):
            full = [self.common / n > self.completeness for n in size]
            if all(full) or self.common > self.overlap:
                self.done = True
                break
            to = 1 if size[0] > size[1] else 0
            lacks = (d if f else s) if to == 0 else (s if f else d)
            if not full[to] and lacks not in added[to]:
                added[to].add(lacks)
                out.append((to, lacks))
                size[to], self.common = size[to] + 1, self.common + 1
        return out


def expand(labels: DataFrame, lost: DataFrame, *, completeness: float = 0.5, overlap: int = 20) -> DataFrame:
    """Clusters with boundary nodes replicated: (label, id, added).

    Each two clusters are one sequential unit: their lost edges are taken by weight
    (ties by ids), and each gives the cluster that is then smaller (the first if equal)
    the end it lacks, unless the cluster's share of nodes common to both has passed
    ``completeness``; once both have, or more than ``overlap`` nodes are common, the pair
    is done. Units are independent of each other, so a cluster's size in one of them
    does not see what the others add. Units are sorted and read edge by edge; what a unit
    holds is the nodes it has added.
    """
    sizes = _labelled(labels.groupBy("label").agg(F.count("*").alias("n")))
    rows = lost.join(sizes.select(F.col("label").alias("l1"), F.col("n").alias("n1")), "l1").join(sizes.select(F.col("label").alias("l2"), F.col("n").alias("n2")), "l2")
    rows = rows.join(_labelled(labels).select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").select("l1", "l2", "n1", "n2", "src", "dst", "weight", (F.col("ls") == F.col("l1")).alias("first"))
    rows = rows.repartition("l1", "l2").sortWithinPartitions("l1", "l2", F.desc("weight"), "src", "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit = given = None
        for batch in batches:
            l1, l2, n1, n2, src, dst, first = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("l1", "l2", "n1", "n2", "src", "dst", "first"))
            new = np.flatnonzero((l1[1:] != l1[:-1]) | (l2[1:] != l2[:-1])) + 1
            out: list[tuple[int, int]] = []
            for low, high in zip([0, *new.tolist()], [*new.tolist(), len(l1)]):
                if low < high and (own := (int(l1[low]), int(l2[low]))) != unit:  # else it goes on from the last batch
                    unit, given = own, _Given(int(n1[low]), int(n2[low]), completeness, overlap)
                if low < high and not given.done:
                    out += [(unit[k], i) for k, i in given.take(src[low:high].tolist(), dst[low:high].tolist(), first[low:high].tolist())]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["label", "id"])

    taken = rows.mapInArrow(run, "label bigint, id bigint").distinct()
    return labels.select("label", "id", F.lit(False).alias("added")).unionByName(taken.select("label", "id", F.lit(True).alias("added")))


def _bisect(members: DataFrame, edges: DataFrame, wide: DataFrame, branching: int) -> DataFrame:
    """Members (label, id) of the clusters ``wide`` (label) cut into ``branching`` parts."""
    rows = members.join(wide.select("label"), "label", "left_semi")
    ends = lambda c: rows.select("label", F.col("id").alias(c))
    inner = edges.join(ends("src"), "src").join(ends("dst"), ["label", "dst"]).select("label", "src", "dst", "weight")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        label = normalised_cut(len(ids), np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy(dtype=float), min(branching, len(ids)))
        return pd.DataFrame({"label": pdf["label"].iloc[0], "id": ids, "part": label})

    parts = inner.groupBy("label").applyInPandas(run, "label bigint, id bigint, part int")
    # Nodes without inner edges are dealt to the parts by id.
    cut_ = rows.join(parts, ["label", "id"], "left").withColumn("part", F.coalesce("part", F.pmod(F.xxhash64("id"), F.lit(branching)).cast("int")))
    return cut_.select(F.xxhash64("label", "part").alias("label"), "id")


def cut_and_expand(edges: DataFrame, size: int, *, branching: int = 2, relax: float = 1.3, completeness: float = 0.5, overlap: int = 20, rounds: int = 20) -> DataFrame:
    """Overlapping clusters (label, id) of at most ``relax * size`` nodes.

    Clusters are cut in two until they have at most ``size`` nodes, then expanded; those
    that have grown beyond ``relax * size`` are cut again with what they were given, and
    only their parts are expanded anew, until none is too large. Cuts lower a
    cluster's size, so this ends; after ``rounds`` expansions clusters that would still
    grow too large are left as cut. Components of up to ``DENSE`` nodes are one task's.
    """
    edges = cut_packed(edges.select("src", "dst", "weight"))
    nodes = cut(nodes_of(edges))
    whole = cut(components(nodes, edges))
    sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
    blocks = cut(whole.join(sizes.filter(F.col("n") <= DENSE), "component").select("id", F.col("component").alias("block")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, weights = _edges_of(pdf["blob"])
        ids = np.unique(np.concatenate([src, dst]))
        found = _regrouped(len(ids), np.searchsorted(ids, src), np.searchsorted(ids, dst), weights, size, branching, relax, completeness, overlap, rounds)
        each = np.repeat(np.arange(len(found)), [len(c) for c in found])
        return pd.DataFrame({"block": pdf["block"].iloc[0], "part": each, "id": ids[np.concatenate(found)]})

    held = _inside(edges, blocks).groupBy("block").applyInPandas(run, "block bigint, part bigint, id bigint")
    held = cut(held.select(F.xxhash64("block", "part").alias("label"), "id"))
    if sizes.filter(F.col("n") > DENSE).isEmpty():
        return held
    rest = edges.join(_labelled(blocks.select(F.col("id").alias("src"))), "src", "left_anti")
    return held.unionByName(_cut_and_expand(rest, size, branching, relax, completeness, overlap, rounds))


def _regrouped(n: int, rows, cols, weights, size: int, branching: int, relax: float, completeness: float, overlap: int, rounds: int) -> list[np.ndarray]:
    """``cut_and_expand`` of one component as a matrix: its clusters' nodes."""
    w = _matrix(n, rows, cols, weights)
    first = normalised_cut(n, rows, cols, weights, max(1, n // size))
    members, done = [np.flatnonzero(first == k) for k in np.unique(first)], []
    src, dst = np.nonzero(np.triu(w))
    order = np.argsort(-w[src, dst], kind="stable")  # by weight, src, dst
    src, dst = src[order], dst[order]
    for k in range(rounds + 1):
        left, members = members, []
        while left:
            part = left.pop()
            if len(part) <= size:
                members.append(part)
            else:
                left += _halves(part, w, branching)
        if k == rounds:
            break
        home = np.full(n, -1)
        for i in reversed(range(len(members))):
            home[members[i]] = i
        count = np.bincount(home[home >= 0], minlength=len(members))
        x, y = home[src], home[dst]
        far = np.flatnonzero((x >= 0) & (y >= 0) & (x != y))
        l1, l2 = np.minimum(x[far], y[far]), np.maximum(x[far], y[far])
        order = np.lexsort((l2, l1))
        far, l1, l2 = far[order], l1[order], l2[order]
        sides = np.flatnonzero(np.r_[True, (l1[1:] != l1[:-1]) | (l2[1:] != l2[:-1])]).tolist() if len(far) else []
        grown, a, b, at = [set(m.tolist()) for m in members], src[far], dst[far], home[src[far]] == l1
        for low, high in zip(sides, [*sides[1:], len(far)]):
            pair = int(l1[low]), int(l2[low])
            given = _Given(int(count[pair[0]]), int(count[pair[1]]), completeness, overlap)
            for side, i in given.take(a[low:high].tolist(), b[low:high].tolist(), at[low:high].tolist()):
                grown[pair[side]].add(i)
        members = [np.array(sorted(g)) for g in grown]
        done += [m for m in members if len(m) <= relax * size]
        members = [m for m in members if len(m) > relax * size]
        if not members:
            break
    return done + members


def _cut_and_expand(edges: DataFrame, size: int, branching: int, relax: float, completeness: float, overlap: int, rounds: int) -> DataFrame:
    """``cut_and_expand`` of components too large for a matrix, by joins."""
    edges = cut_packed(edges)
    first = assign(edges, size)
    members, done = cut(first.select("label", "id")), None
    for k in range(rounds + 1):
        for _ in range(64):
            wide = members.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > size)
            wide = cut(wide)
            if wide.isEmpty():
                break
            members = cut(members.join(wide, "label", "left_anti").unionByName(_bisect(members, edges, wide, branching)))
        if k == rounds:
            break
        # A node may be in several clusters by now; its home is the smallest label.
        home = members.groupBy("id").agg(F.min("label").alias("label"))
        _, lost = split_edges(edges, home)
        grown = cut(expand(home, lost, completeness=completeness, overlap=overlap).select("label", "id").unionByName(members).distinct())
        large = cut(grown.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > relax * size))
        small = grown.join(large, "label", "left_anti")
        done = cut(small if done is None else done.unionByName(small).distinct())
        if large.isEmpty():
            return done
        members = cut(grown.join(large, "label", "left_semi"))
    return done.unionByName(members).distinct()


def dispatch_order(members: DataFrame) -> DataFrame:
    """Clusters by size, largest first: (label, n, position from 0); ties by label."""
    from .pairs import numbered

    sizes = members.groupBy("label").agg(F.count("*").alias("n")).withColumn("_n", -F.col("n"))
    return numbered(sizes, ["_n", "label"]).select("label", "n", "position")


def with_clusters(images: DataFrame, members: DataFrame) -> DataFrame:
    """Images (image_id) with ``cluster_id``: the smallest of their clusters' labels, null without one."""
    home = members.groupBy(F.col("id").alias("image_id")).agg(F.min("label").alias("cluster_id"))
    return images.drop("cluster_id").join(home, "image_id", "left")


def min_cuts(edges: DataFrame) -> DataFrame:
    """The minimum cut of each group's graph: (group, value, side), the side as sorted
    ids; ``edges``: (group, src, dst, weight), a group is one dense matrix."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        value, side = min_cut(len(ids), np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy(dtype=float))
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "value": [value], "side": [ids[side].tolist()]})

    return edges.groupBy("group").applyInPandas(run, "group bigint, value double, side array<bigint>")


def terminal_cuts(edges: DataFrame) -> DataFrame:
    """The maximum flow of each group between its smallest and its largest node:
    (group, source, sink, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["src", "dst"])
        ids = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        rows, cols, w = np.searchsorted(ids, pdf["src"]), np.searchsorted(ids, pdf["dst"]), pdf["weight"].to_numpy(dtype=float)
        value, _ = max_flow(len(ids), np.concatenate([rows, cols]), np.concatenate([cols, rows]), np.concatenate([w, w]), 0, len(ids) - 1)
        return pd.DataFrame({"group": [pdf["group"].iloc[0]], "source": [ids[0]], "sink": [ids[-1]], "value": [value]})

    return edges.groupBy("group").applyInPandas(run, "group bigint, source bigint, sink bigint, value double")


def expand_all(labels: DataFrame, inner: DataFrame, lost: DataFrame) -> DataFrame:
    """Every lost edge into the one of its clusters that has fewer edges."""
    counts = inner.groupBy("label").agg(F.count("*").alias("n"))
    have = lambda c, n: counts.select(F.col("label").alias(c), F.col("n").alias(n))
    rows = lost.join(have("l1", "n1"), "l1", "left").join(have("l2", "n2"), "l2", "left").na.fill(0, ["n1", "n2"])
    to = F.when(F.col("n1") <= F.col("n2"), F.col("l1")).otherwise(F.col("l2"))
    placed = rows.select(to.alias("label"), "src", "dst", "weight")
    members = placed.select("label", F.col("src").alias("id")).unionByName(placed.select("label", F.col("dst").alias("id"))).unionByName(labels.select("label", "id"))
    return members.distinct()


def hierarchy(edges: DataFrame, leaf: int, branching: int = 2, overlap: int = 0) -> DataFrame:
    """Leaves of a cluster tree: (id, label, added).

    A level splits every cluster above ``leaf`` nodes into ``branching`` parts;
    with ``overlap`` each leaf also gets up to so many nodes across its boundary,
    by the heaviest edges. A graph of more than ``DENSE`` nodes begins as the blocks of
    label propagation, so that no task holds more than a block's matrix.
    """
    edges = cut_packed(edges.select("src", "dst", "weight"))
    nodes = cut(nodes_of(edges))
    blocks, across = cut(nodes.withColumn("block", F.lit(0).cast("long"))), False
    if nodes.count() > DENSE:
        whole = cut(components(nodes, edges))
        sizes = whole.groupBy("component").agg(F.count("*").alias("n"))
        blocks = whole.join(sizes, "component").select("id", F.col("component").alias("block"), "n")
        across = not sizes.filter(F.col("n") > DENSE).isEmpty()
        blocks = cut((_propagated(edges, blocks, DENSE) if across else blocks).select("id", "block"))
    wide = blocks.groupBy("block").agg(F.count("*").alias("n")).filter(F.col("n") > leaf)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst, weights = _edges_of(pdf["blob"])
        ids = np.unique(np.concatenate([src, dst]))
        rows, cols = np.searchsorted(ids, src), np.searchsorted(ids, dst)
        label = _leaves(len(ids), rows, cols, weights, leaf, branching)
        to, given, weight = _offers(label, rows, cols, weights, overlap)
        return pd.DataFrame({"id": ids[np.concatenate([np.arange(len(ids)), given])], "label": ids[np.concatenate([label, to])], "weight": np.concatenate([np.zeros(len(ids)), weight]), "added": np.arange(len(ids) + len(to)) >= len(ids)})

    inside = _inside(edges, blocks.join(wide.select("block"), "block", "left_semi"))
    found = cut(inside.groupBy("block").applyInPandas(run, "id bigint, label bigint, weight double, added boolean"))
    # Small blocks are leaves; nodes without edges in a wide block stand alone.
    leaves = found.filter("NOT added").select("id", "label")
    now = blocks.join(wide, "block", "left").join(leaves, "id", "left").select("id", F.coalesce("label", F.when(F.col("n").isNull(), F.col("block")), "id").alias("label"))
    now = cut(now)
    if not overlap:
        return now.withColumn("added", F.lit(False))
    offers = found.filter("added").select("label", "id", "weight")
    if across:  # those between blocks
        known = _labelled(blocks)
        between = edges.join(known.select(F.col("id").alias("src"), F.col("block").alias("b1")), "src").join(known.select(F.col("id").alias("dst"), F.col("block").alias("b2")), "dst").filter("b1 <> b2")
        known = _labelled(now)
        both = between.join(known.select(F.col("id").alias("src"), F.col("label").alias("ls")), "src").join(known.select(F.col("id").alias("dst"), F.col("label").alias("ld")), "dst")
        more = both.select(F.explode(F.array(F.struct(F.col("ls").alias("label"), F.col("dst").alias("id")), F.struct(F.col("ld").alias("label"), F.col("src").alias("id")))).alias("o"), F.col("weight").cast("double").alias("weight"))
        offers = offers.unionByName(more.groupBy("o").agg(F.max("weight").alias("weight")).select("o.label", "o.id", "weight"))
    order = Window.partitionBy("label").orderBy(F.desc("weight"), "id")
    taken = offers.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= overlap).select("id", "label", F.lit(True).alias("added"))
    return now.withColumn("added", F.lit(False)).unionByName(taken)


def _halves(part: np.ndarray, w: np.ndarray, branching: int) -> list[np.ndarray]:
    """Nodes cut into parts by their edges ``w`` (a matrix); the last part: those without."""
    own = w[np.ix_(part, part)]
    linked = own.any(axis=1)
    used, rest = part[linked], part[~linked]
    if not len(used):
        return [rest[: len(rest) // 2], rest[len(rest) // 2 :]]
    own = own[np.ix_(linked, linked)]
    i, j = np.nonzero(np.triu(own))
    label = normalised_cut(len(used), i, j, own[i, j], min(branching, len(used)))
    if not len(rest) and not label.any():
        label[len(label) // 2 :] = 1
    return [x for x in (*(used[label == k] for k in range(branching)), rest) if len(x)]


def _matrix(n: int, rows: np.ndarray, cols: np.ndarray, weights: np.ndarray) -> np.ndarray:
    w = np.zeros((n, n))
    far = rows != cols
    np.add.at(w, (rows[far], cols[far]), weights[far])
    np.add.at(w, (cols[far], rows[far]), weights[far])
    return w


def _leaves(n: int, rows, cols, weights, leaf: int, branching: int) -> np.ndarray:
    """Each node's leaf, as its smallest node, of a block's tree of cuts."""
    w, label, left = _matrix(n, rows, cols, weights), np.zeros(n, dtype=np.int64), [np.arange(n)]
    while left:
        part = left.pop()
        if len(part) <= leaf:
            label[part] = part.min()
        else:
            left += _halves(part, w, branching)
    return label


def _offers(label: np.ndarray, rows, cols, weights, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(label, node, weight): up to ``most`` nodes a label by their heaviest edges to it."""
    far = label[rows] != label[cols]
    to, given, weight = np.concatenate([label[rows[far]], label[cols[far]]]), np.concatenate([cols[far], rows[far]]), np.tile(weights[far], 2)
    order = np.lexsort((-weight, given, to))
    to, given, weight = to[order], given[order], weight[order]
    one = np.ones(len(to), dtype=bool)
    one[1:] = (to[1:] != to[:-1]) | (given[1:] != given[:-1])
    to, given, weight = to[one], given[one], weight[one]
    order = np.lexsort((given, -weight, to))
    to, given, weight = to[order], given[order], weight[order]
    few = np.arange(len(to)) - np.searchsorted(to, to) < most
    return to[few], given[few], weight[few]


def common_nodes(members: DataFrame) -> DataFrame:
    """Nodes that two clusters share: (label1 < label2, common)."""
    a, b = members.select(F.col("label").alias("label1"), "id"), members.select(F.col("label").alias("label2"), "id")
    return a.join(b, "id").filter("label1 < label2").groupBy("label1", "label2").agg(F.count("*").alias("common"))


def repeated_ratio(members: DataFrame) -> DataFrame:
    """Per cluster: nodes shared with others, summed over them, by its size."""
    pairs = common_nodes(members)
    ends = pairs.select(F.col("label1").alias("label"), "common").unionByName(pairs.select(F.col("label2").alias("label"), "common")).groupBy("label").agg(F.sum("common").alias("common"))
    sizes = members.groupBy("label").agg(F.count("*").alias("n"))
    return sizes.join(ends, "label", "left").select("label", "n", F.round(F.coalesce("common", F.lit(0)) / F.col("n"), 6).alias("ratio"))


def summary(nodes: DataFrame, edges: DataFrame, members: DataFrame, inner: DataFrame) -> DataFrame:
    """Clusters, how often nodes are held, and the share of edges lost."""
    own = members.agg(F.countDistinct("label").alias("clusters"), F.count("*").alias("held"))
    counts = nodes.agg(F.count("*").alias("nodes")).crossJoin(edges.agg(F.count("*").alias("edges"))).crossJoin(inner.agg(F.count("*").alias("kept")))
    return own.crossJoin(counts).select(  # one row each
        "clusters", "nodes", "edges", F.round(F.col("held") / F.col("nodes"), 6).alias("inflation"), F.round(1 - F.col("kept") / F.col("edges"), 6).alias("edge_loss")
    )
