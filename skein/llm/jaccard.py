"""N-gram Jaccard join: connected groups of documents by a prefix-tree join.

A document is the set of its distinct word n-grams (hashed to 64 bits); two
documents link when the sets' Jaccard similarity reaches ``threshold``.

1. Equal sets are one class, represented by its smallest id.
2. Support filter. In any global order, linked sets share their k first common
   n-grams within their prefixes of n - ceil(t n) + k. Ordered by hash, every
   class sends such a prefix once; classes whose prefix holds fewer n-grams known
   elsewhere than any partner requires are out. Only ids and hashes travel.
3. Texts of the classes left are fetched once, and n-grams counted over them.
   The global order is by frequency class, rarest first, then hash. A class of
   which less than the needed share occurs elsewhere is out; the others post
   their prefix.
4. The join itself runs in tiles. A tile is a trie of some sets, most frequent
   n-gram first, so that sets share the path of what they have in common; other
   sets are probed through it: a probe descends once with partial overlaps, and
   subtrees whose remaining length cannot reach the needed overlap are pruned. What
   comes out of a tile are the linked pairs; nobody lists pairs before. The first
   tiles are stars: holders of the same prefix n-gram are put round the one with the
   smallest share of n-grams of its own (each holder joins its most frequent
   centre), and the centre is probed through the trie of its members.
5. Links give components. Holders of a prefix n-gram that are still in different
   components meet in tiles too: sets are dealt to blocks, and two blocks make a tile
   of those of their sets that hold a common n-gram, unless they are of one component.
   Lengths and positions leave holders out before (nothing before the first common
   n-gram is common, which bounds the overlap by what follows it). Pairs within a
   component need no check for the groups: they cannot change them, and a tile passes
   over subtrees of the probe's own component. So no link that connects is lost and
   ``groups`` expands no group into all its pairs.
6. ``links`` returns each document's number of links, for which all linked pairs are
   found. They lie within components. A component's sets are dealt to blocks; where
   two blocks hold the same prefix n-gram, its holders meet in a tile. The work grows
   with the number of links.

N-grams are compared by 64-bit hashes and equal sets by 128-bit sums of them. Two
sets of 1 000 n-grams each share a false n-gram with a chance of 1e6 / 2^64 = 5e-14;
a link would need as many as the threshold asks. Postings are dealt to parts whose
number grows with the n-grams counted (``PART_GRAMS`` a part); postings of one n-gram
lie in one part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skein.operators.components import connected_components

from . import common
from .common import NONBLANK, WordHasher, bounded, by_key, cut, joined, mix64, shingle_hashes, text_groups

N = 5
#: The threshold as a fraction, so that bounds are exact integers.
THRESHOLD = (75, 100)
#: Share of a set (1 / SLACK) by which the support prefix is longer than needed.
SLACK = 16
#: Prefix n-grams of a set that look for a star's centre; step 5 uses all.
STARS = 16
#: Sets and n-grams of a block of steps 5 and 6; members of a star's tile.
BLOCK, BLOCK_GRAMS, STAR = 64, 1 << 19, 4_096
#: Holders of an n-gram that one task lists against the other blocks at least.
CROWD = 512
#: N-grams whose postings make one part of the hash range.
PART_GRAMS = 1 << 22


def shingle_sets(texts: list[bytes], hasher: WordHasher, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    buf, offsets = joined(texts, NONBLANK)
    starts, _, words = hasher(buf)
    bounds = np.append(np.searchsorted(starts, offsets), len(words))
    out = []
    for low, high in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        k = min(n, high - low)
        # The length enters, so a short text never equals an n-gram.
        out.append(np.unique(shingle_hashes(words[low:high], k) + np.uint64(k)) if k else np.empty(0, dtype=np.uint64))
    return out


def needed(n, t=THRESHOLD):
    """ceil(t n): the least overlap of a set of n with any partner."""
    return -(-n * t[0] // t[1])


def linked(overlap: int, n: int, m: int, t=THRESHOLD) -> bool:
    """Whether sets of n and m with this overlap reach the threshold."""
    return t[1] * overlap >= t[0] * (n + m - overlap)


def _slack(n):
    return np.maximum(1, n // SLACK)


def _digest(s: np.ndarray) -> bytes:
    a, b = mix64(s), mix64(s ^ np.uint64(0x5851F42D4C957F2D))
    return int(a.sum(dtype=np.uint64)).to_bytes(8, "big") + int(b.sum(dtype=np.uint64)).to_bytes(8, "big")


def _class_id(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "big", signed=True)


SETS = "doc_id bigint, th bigint, n_shingles bigint, digest binary"


def _describe(n):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(2)):
                sets = shingle_sets(texts, hasher, n)
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())],
                    ["doc_id", "th", "n_shingles", "digest"],
                )

    return run


#: Postings: for each document of a map batch, the stretch of its sorted set that
#: falls into one part of the hash range. Hashes are cut into 32 + 16 + 16 bits.
POSTED = "pid int, ids binary, starts binary, counts binary, a binary, b binary, c binary, rank binary"
_POSTED = [("pid", pa.int32()), *((n, pa.binary()) for n in ("ids", "starts", "counts", "a", "b", "c", "rank"))]


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), _POSTED)], [n for n, _ in _POSTED])


def _pack(sets: list[np.ndarray], ids: np.ndarray, parts: int, *, short: bool) -> Iterator[pa.RecordBatch]:
    """One row a part of the hash range; ``short`` leaves out the last 16 bits."""
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if sets else np.empty(0, dtype=np.uint64)
    if not len(flat):
        return
    owner, pid = np.repeat(np.arange(len(sets)), sizes), _part(flat, parts)
    edge = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (pid[1:] != pid[:-1])))
    counts, first = np.diff(np.append(edge, len(flat))), (np.cumsum(sizes) - sizes)[owner[edge]]
    yield from _pack_stretches(pid[edge].astype(np.int64), ids[owner[edge]], edge - first, counts, edge, flat, None, short)


def _pack_stretches(pid, ids, starts, counts, at, hashes, rank, short: bool) -> Iterator[pa.RecordBatch]:
    order = np.argsort(pid, kind="stable")
    pid, ids, starts, counts, at = pid[order], ids[order], starts[order], counts[order], at[order]
    take = np.repeat(at - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    hashes = hashes[take]
    rank = None if rank is None else rank[take]
    ends, rows = np.cumsum(counts), []
    edge = np.append(np.flatnonzero(np.append(True, pid[1:] != pid[:-1])), len(pid))
    for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
        h = hashes[ends[x] - counts[x] : ends[y - 1]]
        a, b, c = (h >> np.uint64(32)).astype(np.uint32), (h >> np.uint64(16)).astype(np.uint16), None if short else h.astype(np.uint16).tobytes()
        r = None if rank is None else rank[ends[x] - counts[x] : ends[y - 1]].tobytes()
        rows.append((int(pid[x]), ids[x:y].tobytes(), starts[x:y].astype(np.uint32).tobytes(), counts[x:y].astype(np.uint32).tobytes(), a.tobytes(), b.tobytes(), c, r))
    yield _batch(rows)


def _gather(batches):
    """All stretches of a part: ids, starts, counts, and their hashes and ranks."""
    rows = [r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(1, 8)))]
    if not rows:
        return None
    read = lambda i, kind: np.frombuffer(b"".join(r[i] for r in rows), dtype=kind)
    hashes = (read(3, np.uint32).astype(np.uint64) << np.uint64(32)) | (read(4, np.uint16).astype(np.uint64) << np.uint64(16))
    if rows[0][5] is not None:
        hashes |= read(5, np.uint16).astype(np.uint64)
    return read(0, np.int64), read(1, np.uint32).astype(np.int64), read(2, np.uint32).astype(np.int64), hashes, None if rows[0][6] is None else read(6, np.uint8)


def _times(hashes: np.ndarray) -> np.ndarray:
    """How often each posting's hash occurs."""
    order = np.argsort(hashes, kind="stable")
    edge = np.flatnonzero(np.append(True, hashes[order][1:] != hashes[order][:-1]))
    n = np.diff(np.append(edge, len(hashes)))
    out = np.empty(len(hashes), dtype=np.int64)
    out[order] = np.repeat(n, n)
    return out


def _target(ids: np.ndarray, parts: int) -> np.ndarray:
    return _part(mix64(ids.view(np.uint64)), parts).astype(np.int64)


def _post_support(n, t, parts):
    """Step 2, map side: each class's prefix by hash, once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, seen, held, ids, size = WordHasher(), set(), [], [], 0
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                for s in shingle_sets(texts, hasher, n):
                    if len(s) and (digest := _digest(s)) not in seen:
                        seen.add(digest)
                        held.append(s[: len(s) - needed(len(s), t) + int(_slack(len(s)))].copy())
                        ids.append(_class_id(digest))
                        size += len(held[-1])
                if size > 1 << 19:
                    yield from _pack(held, np.array(ids, dtype=np.int64), parts, short=True)
                    held, ids, size = [], [], 0
        if held:
            yield from _pack(held, np.array(ids, dtype=np.int64), parts, short=True)

    return run


COUNTED = "pid int, ids binary, counts binary"


def _count_support(parts):
    """Step 2, reduce side: for each class, its n-grams that others sent too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is None:
            return
        ids, _, counts, hashes, _ = got
        shared = np.add.reduceat((_times(hashes) > 1).astype(np.int64), np.cumsum(counts) - counts)
        own, where = np.unique(ids, return_inverse=True)
        total = np.bincount(where, weights=shared).astype(np.uint32)
        own, total = own[total > 0], total[total > 0]
        target = _target(own, parts)
        order = np.argsort(target, kind="stable")
        edge = np.searchsorted(target[order], np.arange(parts + 1))
        rows = [(p, own[order[x:y]].tobytes(), total[order[x:y]].tobytes()) for p, (x, y) in enumerate(zip(edge[:-1], edge[1:])) if x < y]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], ["pid", "ids", "counts"])

    return run


def _sum_support(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [r for batch in batches for r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
    if rows:
        own, where = np.unique(np.frombuffer(b"".join(r[0] for r in rows), dtype=np.int64), return_inverse=True)
        total = np.bincount(where, weights=np.frombuffer(b"".join(r[1] for r in rows), dtype=np.uint32))
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(total.astype(np.int64))], ["class_id", "shared"])


def _post_all(n, parts):
    """Step 3, map side: the whole sets of fetched texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                ids = batch.column(0).slice(first, len(texts)).to_numpy()
                yield from _pack(shingle_sets(texts, hasher, n), ids, parts, short=False)

    return run


def _rank(parts):
    """Step 3, reduce side: frequency classes, sent on to the sets' parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is not None:
            ids, starts, counts, hashes, _ = got
            times = _times(hashes)
            rank = np.where(times > 1, np.ceil(np.log2(times)), 0).astype(np.uint8)
            yield from _pack_stretches(_target(ids, parts), ids, starts, counts, np.cumsum(counts) - counts, hashes, rank, False)

    return run


ORDERED = "id bigint, n bigint, alone bigint, grams binary, prefix binary, at binary"


def _order(t):
    """Step 3: put the sets together again, ordered; drop those without support.

    ``grams`` is the set, most frequent n-gram first (the trie's order), ``alone``
    its number of n-grams that occur nowhere else; ``prefix`` the others within
    the prefix of the reverse order and ``at`` their positions in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = _gather(batches)
        if got is None:
            return
        ids, starts, counts, hashes, ranks = got
        at, order = np.cumsum(counts) - counts, np.lexsort((starts, ids))
        edge = np.append(np.flatnonzero(np.append(True, ids[order][1:] != ids[order][:-1])), len(order))
        out = []
        for x, y in zip(edge[:-1].tolist(), edge[1:].tolist()):
            own = order[x:y]
            take = np.concatenate([np.arange(at[i], at[i] + counts[i]) for i in own])
            grams, first = np.unique(hashes[take], return_index=True)  # a repeated row sends its set twice
            rank = ranks[take][first]
            least, shared = needed(len(grams), t), int(np.count_nonzero(rank))
            if shared < least:
                continue
            ascending = np.lexsort((grams, rank))
            prefix = np.arange(len(grams) - shared, len(grams) - least + 1, dtype=np.uint32)
            out.append((int(ids[own[0]]), len(grams), len(grams) - shared, grams[ascending[::-1]].tobytes(), grams[ascending[prefix]].tobytes(), prefix.tobytes()))
            if len(out) == 500:
                yield _ordered_batch(out)
                out = []
        if out:
            yield _ordered_batch(out)

    return run


def _ordered_batch(rows):
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["id", "n", "alone", "grams", "prefix", "at"])


class Trie:
    """Globally ordered sets as paths; equal beginnings are stored once."""

    def __init__(self) -> None:
        self.root = _Node(np.empty(0, dtype=np.uint64))

    def insert(self, grams: np.ndarray, key, mark=None) -> None:
        node, at, n = self.root, 0, len(grams)
        node.see(n, mark)
        while True:
            if at == n:
                node.keys.append(key)
                return
            below = node.below.get(int(grams[at]))
            if below is None:
                leaf = _Node(grams[at:])
                leaf.see(n, mark)
                leaf.keys.append(key)
                node.below[int(grams[at])] = leaf
                return
            k = min(len(below.grams), n - at)
            differ = np.flatnonzero(below.grams[:k] != grams[at : at + k])
            k = int(differ[0]) if len(differ) else k
            if k < len(below.grams):
                below.split(k)
            below.see(n, mark)
            node, at = below, at + k

    def search(self, grams: np.ndarray, t=THRESHOLD, skip=None) -> Iterator[tuple[int, int, object]]:
        """(overlap, size, key) of the sets that link with ``grams``; subtrees whose
        sets all have one mark are left out if ``skip(mark)``."""
        probe, n = np.sort(grams), len(grams)
        stack = [(self.root, 0, 0)]
        while stack:
            node, overlap, depth = stack.pop()
            if skip is not None and not node.mixed and node.mark is not None and skip(node.mark):
                continue
            if len(node.grams):
                at = np.minimum(np.searchsorted(probe, node.grams), n - 1)
                overlap += int(np.count_nonzero(probe[at] == node.grams))
                depth += len(node.grams)
            for key in node.keys:
                if linked(overlap, n, depth, t):
                    yield overlap, depth, key
            # Remaining-length bound: the most that a set below can still share.
            most = overlap + min(node.longest - depth, n - overlap)
            if node.below and linked(most, n, max(node.shortest, most), t):
                stack += [(x, overlap, depth) for x in node.below.values()]


class _Node:
    def __init__(self, grams) -> None:
        self.grams, self.below, self.keys = grams, {}, []
        self.shortest, self.longest = 1 << 62, 0
        self.mark, self.mixed = None, False

    def see(self, n: int, mark) -> None:
        self.mixed = self.mixed or (self.longest > 0 and mark != self.mark)
        self.mark = mark
        self.shortest, self.longest = min(self.shortest, n), max(self.longest, n)

    def split(self, k: int) -> None:
        rest = _Node(self.grams[k:])
        rest.below, rest.keys, rest.shortest, rest.longest = self.below, self.keys, self.shortest, self.longest
        rest.mark, rest.mixed = self.mark, self.mixed
        self.grams, self.below, self.keys = self.grams[:k], {int(rest.grams[0]): rest}, []


#: Rows of tiles. Sets of side 1 are put into the tile's trie, those of side 0 are
#: probed through it, those of side 2 are both (each pair once). ``mark`` is a set's
#: component, or its number of copies where links are summed.
TILE = "tile bigint, x bigint, y bigint, side int, id bigint, grams binary, mark bigint"
_PROBE, _HELD, _BOTH = 0, 1, 2


def _linked(rows, t) -> list[tuple[int, int]]:
    """All linked pairs of a tile's rows (side, id, grams, mark)."""
    trie = Trie()
    for side, i, grams, _ in rows:
        if side != _PROBE:
            trie.insert(grams, (i, side))
    return [(i, j) for side, i, grams, _ in rows if side != _HELD for _, _, (j, other) in trie.search(grams, t) if side == _PROBE or other == _HELD or i < j]


def _connected(rows, t) -> list[tuple[int, int]]:
    """Linked pairs of a tile that join its components: none within one, and no more
    than it takes."""
    trie, parent, out = Trie(), {}, []

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    marks = {i: mark for _, i, _, mark in rows}
    for side, i, grams, mark in rows:
        if side != _PROBE:
            trie.insert(grams, i, mark)
    for side, i, grams, mark in rows:
        if side != _HELD:
            for _, _, j in trie.search(grams, t, lambda other, own=mark: root(other) == root(own)):
                if root(marks[j]) != root(mark):
                    parent[root(marks[j])] = root(mark)
                    out.append((i, j))
    return out


def _summed(rows, t) -> list[tuple[int, int]]:
    """Each set's copies of its partners."""
    copies, more = {i: c for _, i, _, c in rows}, {}
    for i, j in _linked(rows, t):
        more[i] = more.get(i, 0) + copies[j]
        more[j] = more.get(j, 0) + copies[i]
    return list(more.items())


def _join(t, find=_linked):
    """What ``find`` gets from tiles whose rows come one tile after the other."""

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows, out = None, [], []
        for rows_ in batches:
            keys = zip(*(rows_.column(i).to_pylist() for i in range(3)))
            for now, side, i, grams, mark in zip(keys, *(rows_.column(i).to_pylist() for i in range(3, 7))):
                if now != key:
                    out += find(rows, t)
                    key, rows = now, []
                rows.append((side, i, np.frombuffer(grams, dtype=np.uint64), mark))
            if len(out) > 10_000:
                yield batch(out)
                out = []
        out += find(rows, t)
        if out:
            yield batch(out)

    return run


def _joined(members: DataFrame, sets: DataFrame, t, find=_linked) -> DataFrame:
    """Pairs (a, b) found in tiles; ``members``: (tile, x, y, side, id, mark), ``sets``: (id, grams)."""
    rows = members.join(sets, "id").select("tile", "x", "y", F.col("side").cast("int").alias("side"), "id", "grams", "mark")
    rows = rows.repartition("tile", "x", "y").sortWithinPartitions("tile", "x", "y")
    return rows.mapInArrow(_join(t, find), "a bigint, b bigint")


def _stars(pairs: DataFrame) -> DataFrame:
    """Tiles of stars from (a, b), b a member round a; a large star is several tiles."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("long").alias("_x")).filter("_x > 1")
    dealt = pairs.join(bounded(cut(many)), "a", "left").withColumn("x", F.coalesce(F.pmod(F.xxhash64("b"), "_x"), F.lit(0).cast("long")))
    members = dealt.select(F.col("a").alias("tile"), "x", F.lit(0).cast("long").alias("y"), F.lit(_HELD).alias("side"), F.col("b").alias("id"))
    centres = members.select("tile", "x", "y", F.lit(_PROBE).alias("side"), F.col("tile").alias("id")).distinct()
    return members.unionByName(centres).withColumn("mark", F.col("id"))


def _met(held: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of stored holders with what their n-grams have elsewhere.

    The holders of a crowded key are dealt to several tasks, each of which gets all of
    ``there`` for it. Crowded are keys of more than ``CROWD`` holders and of more than a
    ``HOT``-th of all, so that at most ``HOT`` keys are broadcast.
    """
    crowd = max(CROWD, -(-held.count() // common.HOT))
    salts = held.groupBy(*keys).agg(F.ceil(F.count("*") / crowd).cast("long").alias("_salts")).filter("_salts > 1")
    salts = F.broadcast(cut(salts))
    many = F.coalesce("_salts", F.lit(1).cast("long"))
    rows = held.join(salts, keys, "left").withColumn("_salt", F.pmod(F.xxhash64("id"), many)).drop("_salts")
    there = there.join(salts, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), many - 1))).drop("_salts")
    return rows.join(there, [*keys, "_salt"]).drop("_salt")


def _blocked(held: DataFrame, t) -> DataFrame:
    """Tiles in which holders of the same n-gram meet, if they are of different
    components; ``held``: (id, n, gram, component, most).

    A component of more than ``BLOCK`` sets fills blocks of its own, which do not meet
    each other; the sets of all others share mixed blocks. A set enters the tile of its
    block and another one once, however many n-grams lead there, and only if some
    holder there has a length and a position that allow a link.
    """
    sizes = cut(held.select("id", "component").distinct().groupBy("component").agg(F.count("*").alias("_n")))
    large = sizes.filter(F.col("_n") > BLOCK).select("component", F.ceil(F.col("_n") / BLOCK).cast("long").alias("_blocks"))
    mixed = max(1, -(-(sizes.filter(F.col("_n") <= BLOCK).agg(F.sum("_n")).first()[0] or 0) // BLOCK))
    held = held.join(bounded(cut(large)), "component", "left").withColumn("kind", F.when(F.col("_blocks").isNotNull(), F.col("component")).otherwise(F.lit(-1)))
    place = F.when(F.col("kind") < 0, F.pmod(F.xxhash64("component"), F.lit(mixed))).otherwise(F.pmod(F.xxhash64("id"), F.col("_blocks")))
    held = held.withColumn("block", F.xxhash64("kind", place)).drop("_blocks")
    there = held.groupBy("gram", F.col("block").alias("other"), F.col("kind").alias("kind2")).agg(
        F.min("n").alias("least2"), F.max("n").alias("n2"), F.max("most").alias("most2"), (F.min("component") != F.max("component")).alias("several")
    )
    met = _met(held, there, ["gram"])
    apart = F.when(F.col("block") == F.col("other"), F.col("several")).otherwise((F.col("kind") != F.col("kind2")) | (F.col("kind") < 0))
    near = (F.col("n") * t[1] >= F.col("least2") * t[0]) & (F.col("n2") * t[1] >= F.col("n") * t[0]) & (F.col("least2") <= F.col("most")) & (F.col("n") <= F.col("most2"))
    side = F.when(F.col("block") == F.col("other"), _BOTH).when(F.col("block") < F.col("other"), _PROBE).otherwise(_HELD)
    met = met.filter(apart & near).select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "id", F.col("component").alias("mark"))
    return met.distinct().withColumn("tile", F.col("x"))


def _ordered_sets(docs: DataFrame, classes: DataFrame, n: int, t) -> DataFrame:
    """Steps 2 and 3: the classes that may link, as ``ORDERED``."""
    total = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_GRAMS))
    dealt = lambda df: df.repartitionById(parts, F.col("pid"))
    counts = dealt(docs.select("text").mapInArrow(_post_support(n, t, parts), POSTED)).mapInArrow(_count_support(parts), COUNTED)
    counts = dealt(counts).mapInArrow(_sum_support, "class_id bigint, shared bigint")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * t[0] / t[1]) / SLACK))
    own = classes.withColumn("class_id", F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long"))
    left = cut(own.join(counts, "class_id").filter(F.col("shared") >= least).select("id", "first", "th"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    texts = texts.join(left, (texts["doc_id"] == left["first"]) & (texts["th"] == left["th"])).select("id", "text")
    ranked = dealt(texts.mapInArrow(_post_all(n, parts), POSTED)).mapInArrow(_rank(parts), POSTED)
    return cut(dealt(ranked).mapInArrow(_order(t), ORDERED))


def class_links(docs: DataFrame, classes: DataFrame, *, n: int = N, t=THRESHOLD) -> DataFrame:
    """Links (a, b) between classes that connect all linked ones; ``all_links`` has the others too.

    ``classes``: (digest, id, first, th, n) of the non-empty classes; ``first`` and
    ``th`` name a document that holds the class's text.
    """
    return _connecting(_ordered_sets(docs, classes, n, t), t)


def _connecting(ordered: DataFrame, t) -> DataFrame:
    """Steps 4 and 5."""
    sets = ordered.select("id", "grams")
    # Step 4. The centre has the smallest share of n-grams of its own.
    held = cut(ordered.select("id", "n", "alone", "prefix", "at").mapInArrow(_postings(STARS), POSTINGS))
    centres = held.groupBy("gram").agg(F.min(F.struct((F.col("mark") / F.col("n")).alias("share"), F.col("id").alias("a"), F.col("n").alias("na"), F.col("reach").alias("ra"))).alias("c"), F.count("*").alias("holders"))
    # An n-gram of many holders would be one key of a shuffled join.
    centres = cut(centres.filter("holders > 1"))
    total = centres.agg(F.sum("holders")).first()[0] or 0
    reach = F.least("reach", "c.ra") * (t[0] + t[1]) >= (F.col("n") + F.col("c.na")) * t[0]
    pairs = by_key(held, centres, "gram", "holders", total).filter((F.col("id") != F.col("c.a")) & reach).groupBy(F.col("id").alias("b"), F.col("c.a").alias("a")).agg(F.count("*").alias("count"))
    pairs = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a")))
    links = cut(_joined(_stars(pairs), sets, t, _connected))
    # Step 5: holders of a prefix n-gram that are still apart and could link.
    found = cut(connected_components(links))
    labelled = cut(ordered.select("id", "n", "prefix", "at").join(found, "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"), "prefix", "at"))
    held = labelled.mapInArrow(_postings(None), POSTINGS).withColumnRenamed("mark", "component")
    # Largest partner that the positions allow: (t0 + t1) reach >= t0 (n + m).
    held = held.withColumn("most", F.floor(F.lit(t[0] + t[1]) * F.col("reach") / t[0]) - F.col("n"))
    apart = (F.min("component") != F.max("component")).alias("apart")
    smallest = cut(held.groupBy("gram").agg(F.min("n").alias("smallest"), F.count("*").alias("holders"), apart).filter("apart").drop("apart"))
    total = smallest.agg(F.sum("holders")).first()[0] or 0
    held = cut(by_key(held, smallest, "gram", "holders", total).filter("most >= smallest").drop("smallest"))
    apart = cut(held.groupBy("gram").agg(F.count("*").alias("holders"), apart).filter("apart"))
    total = apart.agg(F.sum("holders")).first()[0] or 0
    held = cut(by_key(held, apart, "gram", "holders", total).drop("apart"))
    return links.unionByName(_joined(_blocked(held, t), sets, t, _connected))


def all_links(docs: DataFrame, classes: DataFrame, *, n: int = N, t=THRESHOLD) -> DataFrame:
    """All links (a, b) between ``classes``, as in ``class_links``; each pair once."""
    return _every_link(docs, classes, n, t)


def _every_link(docs: DataFrame, classes: DataFrame, n: int, t, find=_linked) -> DataFrame:
    """Step 6."""
    ordered = _ordered_sets(docs, classes, n, t)
    found = connected_components(_connecting(ordered, t))
    members = ordered.select("id", "n").join(found, "id")
    blocks = members.groupBy("component").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_GRAMS)).alias("blocks"))
    members = cut(members.join(blocks, "component").select("id", "component", F.pmod(F.xxhash64("id"), "blocks").alias("block")))
    held = ordered.select("id", "n", "alone", "prefix", "at").mapInArrow(_postings(None), POSTINGS).select("id", "gram").join(members, "id")
    held = cut(held)
    here = held.groupBy("gram", "component", F.col("block").alias("other")).agg(F.count("*").alias("holders"))
    # A holder meets those of the other blocks, and of its own if there are any.
    meets = _met(held, here, ["gram", "component"]).filter((F.col("block") != F.col("other")) | (F.col("holders") > 1))
    side = F.when(F.col("block") == F.col("other"), _BOTH).when(F.col("block") < F.col("other"), _PROBE).otherwise(_HELD)
    meets = meets.select(F.col("component").alias("tile"), F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), side.alias("side"), "id").distinct()
    meets = meets.join(classes.select("id", F.col("copies").alias("mark")), "id")
    return _joined(meets, ordered.select("id", "grams"), t, find)


#: ``mark`` is what comes with a set: its n-grams of its own, or its component.
POSTINGS = "id bigint, n bigint, mark bigint, gram bigint, reach bigint"


def _postings(most: int | None):
    """Each set's prefix n-grams (the first ``most`` of them), of (id, n, mark, prefix,
    at): rows with ``reach``, the number of n-grams from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            grams = [np.frombuffer(x, dtype=np.int64)[:most] for x in batch.column(3).to_pylist()]
            at = [np.frombuffer(x, dtype=np.uint32)[:most].astype(np.int64) for x in batch.column(4).to_pylist()]
            if not grams:
                continue
            own = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
            ids, n, mark = (batch.column(i).to_numpy()[own] for i in range(3))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, n, mark, np.concatenate(grams), n - np.concatenate(at))], ["id", "n", "mark", "gram", "reach"])

    return run


def _classes(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Step 1: (doc_id, text), what describes each row, and the non-empty classes with their number of copies."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    described = cut(docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(_describe(n), SETS))
    own = described.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("digest")
    classes = own.agg(F.min(F.struct("doc_id", "th")).alias("first"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    # Numbered once, as documents that repeat an id may be in several classes.
    classes = cut(classes.select("digest", F.monotonically_increasing_id().alias("id"), F.col("first.doc_id").alias("first"), F.col("first.th").alias("th"), "n", "copies"))
    return docs, described, classes


def links(docs: DataFrame, *, n: int = N, t=THRESHOLD) -> DataFrame:
    """The exact number of links of each document: ``doc_id``, ``n_shingles``, ``n_links``.

    Documents, words and rows are as in ``groups``, whose groups are the components
    over these links. Copies count each; rows without words have no links, nor have
    rows without ``doc_id``, which count for no other row either.
    """
    docs, described, classes = _classes(docs, n)
    # Summed in the tiles, so that no pair becomes a row.
    more = _every_link(docs, classes, n, t, _summed).groupBy(F.col("a").alias("id")).agg(F.sum("b").alias("more"))
    counted = classes.join(more, "id", "left").select("digest", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("_links"))
    out = described.join(counted, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.lit(0)).otherwise(F.col("_links")).cast("long").alias("n_links"))


def groups(docs: DataFrame, *, n: int = N, t=THRESHOLD) -> DataFrame:
    """The group of each document: ``doc_id``, ``n_shingles``, ``component_id``.

    Words are runs of non-blanks, A-Z in lower case; a text of fewer than ``n``
    words is one n-gram, one without words (or null) has none and is its own
    group. ``component_id`` is the smallest ``doc_id`` reachable by links. One row
    per input row; rows without ``doc_id`` cannot be reached and get none; rows
    that repeat an id are documents of their own; an empty table gives no rows.
    Other columns are ignored.
    """
    docs, described, classes = _classes(docs, n)
    found = connected_components(class_links(docs, classes, n=n, t=t))
    named = classes.select("digest", "id", "first").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(least, "component").select("digest", "component_id")
    out = described.join(named, "digest", "left")
    alone = (F.col("n_shingles") == 0) | F.col("doc_id").isNull()
    return out.select("doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


#: Stands for a missing id, behind all others.
_LAST = (1 << 63) - 1


def keep_one(docs: DataFrame, *, n: int = N, t=THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group; all columns stay.

    Groups are those of rows: rows that repeat an id are told apart by their text,
    rows without an id are grouped like others and come behind them. The row with
    the smallest id stays, of rows that share it the one of the smallest text hash,
    of rows that agree in both one. Rows without n-grams all stay. An empty table
    gives no rows.
    """
    # Only ids and hashes until it is known which rows go.
    named, described, classes = _classes(docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), "text"), n)
    found = connected_components(class_links(named, classes, n=n, t=t))
    labelled = classes.select("digest", "id", "first", "th").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    best = labelled.groupBy("component").agg(F.min(F.struct("first", "th")).alias("best"))
    best = labelled.join(best, "component").select("digest", "best")
    rows = described.filter("n_shingles > 0").groupBy("doc_id", "th", "digest").agg(F.count("*").alias("rows")).join(best, "digest")
    rows = cut(rows.select("doc_id", "th", "rows", (F.struct("doc_id", "th") == F.struct("best.first", "best.th")).alias("stays")))
    key = F.struct(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"), F.xxhash64("text").alias("th"))
    keyed = docs.select(F.struct("*").alias("_doc"), key.alias("_key"))
    named_ = lambda df: df.select(F.struct("doc_id", "th").alias("_key")).distinct()
    kept = keyed.join(named_(rows.filter("NOT stays")), "_key", "left_anti")
    repeated = named_(rows.filter("stays AND rows > 1"))
    if not repeated.isEmpty():
        once = kept.join(repeated, "_key", "left_semi").dropDuplicates(["_key"])
        kept = kept.join(repeated, "_key", "left_anti").unionByName(once)
    return kept.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


#: Words, sets, links and the closure in DuckDB.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM w UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) USING (doc_id)
"""

#: The links of each document in DuckDB.
LINKS_ORACLE = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+k-1], ' ') AS g FROM (SELECT doc_id, w, least(len(w), 5) AS k, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, count(*) AS n_links FROM o JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * o >= 75 * (x.n + y.n - o) GROUP BY a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN l ON w.doc_id = l.a
"""
