"""Benchmark decontamination by a prefix-filtered set join.

A window is ``window`` consecutive words of a benchmark item (the whole item if
it is shorter). As a set of word shingles, a window must be contained in the
item-sized stretch of the document it is compared with; at containment 1 the
necessary prefix of a set ordered by rarity is its single rarest shingle. So:

1. count the benchmark's shingles over the whole corpus (rarity);
2. keep for each window its rarest shingle and that shingle's position;
3. look up every document shingle among those prefix shingles, bound the window
   by position (it must begin and end inside the document), and verify the
   candidate word for word.

The benchmark is the small side. It is streamed to the driver in blocks of at
most ``block_bytes`` bytes (a longer item is cut into pieces that overlap by
``window - 1`` words, so that no window is lost); a block's windows are offsets
into one buffer. What is broadcast is bounded whatever the benchmark's size.
Documents are never shuffled: with several blocks each row passes through one
block's index after the other and takes its findings along, so rows never have
to be told apart; after every ``CHAIN`` blocks the rows are written, which bounds
the indexes that a task holds at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import ALNUM, Sent, WordHasher, cut, joined, shingle_hashes, text_groups

WINDOW = 10
SHINGLE = 3
BLOCK_BYTES = 4 << 20
#: Blocks that one task looks up in a row.
CHAIN = 4

#: Per input row: number of words, hit word ranges [start, end), item ids.
FOUND = "doc_id bigint, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"
_CARRIED = "doc_id bigint, text string, n_words bigint, spans array<struct<s:bigint,e:bigint>>, items array<string>"


class Index:
    """Windows of one benchmark block and, once ranked, their prefix shingles.

    ``items``: (item id, normalised words joined by single blanks). A window is a
    word position and a size; equal windows are held once, with all their items.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.names = sorted({name for name, _ in items})
        place = {name: i for i, name in enumerate(self.names)}
        self.buf, offsets = joined([text for _, text in items], ALNUM)
        self.starts, self.ends, self.hashes = WordHasher()(self.buf)
        bounds = np.append(np.searchsorted(self.starts, offsets), len(self.starts)).astype(np.int64)
        n = np.diff(bounds)
        size = np.minimum(window, n)
        counts = np.where(n > 0, n - size + 1, 0)
        item = np.repeat(np.arange(len(items)), counts)
        first = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + bounds[item]
        owner = np.array([place[name] for name, _ in items], dtype=np.int64)[item]
        size, key = size[item], np.zeros(len(item), dtype=np.uint64)
        for k in np.unique(size).tolist():
            own = size == k
            key[own] = shingle_hashes(self.hashes, k)[first[own]]
        self._group(first, size, key, owner)
        # The shingles of each window, all of one length k; shorter windows are one shingle.
        self.k = np.minimum(SHINGLE, self.size)
        self.vocab = {}
        for k in np.unique(self.k).tolist():
            own = np.flatnonzero(self.k == k)
            self.vocab[k] = np.unique(np.concatenate([self._own(w, k) for w in own]))

    def _own(self, w: int, k: int) -> np.ndarray:
        return shingle_hashes(self.hashes[self.first[w] : self.first[w] + self.size[w]], k)

    def text(self, w: int) -> bytes:
        first = self.first[w]
        return self.buf[self.starts[first] : self.ends[first + self.size[w] - 1]]

    def _group(self, first, size, key, owner) -> None:
        """Equal windows become one; windows of equal hash are compared byte by byte."""
        order = np.lexsort((first, key, size))
        first, size, key, owner = first[order], size[order], key[order], owner[order]
        self.first, self.size = first, size
        group, heads = np.zeros(len(first), dtype=np.int64), []
        fresh = np.append(True, (key[1:] != key[:-1]) | (size[1:] != size[:-1])) if len(first) else np.empty(0, dtype=bool)
        known: dict[bytes, int] = {}
        for w, new in enumerate(fresh.tolist()):
            alone = new and (w + 1 == len(fresh) or fresh[w + 1])
            if new:
                known = {}
            text = b"" if alone else self.text(w)
            if text not in known:
                known[text] = len(heads)
                heads.append(w)
            group[w] = known[text]
        pairs = np.unique(np.stack([group, owner], axis=1), axis=0) if len(group) else np.empty((0, 2), dtype=np.int64)
        self.item_at, self.item = np.searchsorted(pairs[:, 0], np.arange(len(heads) + 1)), pairs[:, 1]
        self.first, self.size = first[heads], size[heads]

    def items_of(self, w: int) -> list[str]:
        return [self.names[i] for i in self.item[self.item_at[w] : self.item_at[w + 1]]]

    def count(self, words: np.ndarray, bounds: np.ndarray) -> dict[int, np.ndarray]:
        """Occurrences of each vocabulary shingle in a run of documents."""
        out = {}
        for k, vocab in self.vocab.items():
            at = _lookup(vocab, _own_shingles(words, bounds, k)[0])
            out[k] = np.bincount(at[at >= 0], minlength=len(vocab))
        return out

    def rank(self, counts: dict[int, np.ndarray]) -> None:
        """Keep each window's rarest shingle: its hash, position and window."""
        self.prefix = {}
        for k in self.vocab:
            rows = []
            for w in np.flatnonzero(self.k == k).tolist():
                own = self._own(w, k)
                rarity = counts[k][np.searchsorted(self.vocab[k], own)]
                best = int(np.lexsort((own, rarity))[0])
                rows.append((own[best], best, w))
            rows.sort(key=lambda r: r[0])
            keys = np.array([r[0] for r in rows], dtype=np.uint64)
            self.prefix[k] = keys, np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        self.vocab = None

    def hits(self, buf: bytes, starts, ends, words, bounds) -> list[tuple[int, int, int]]:
        """(first word, size, window) of each verified occurrence."""
        out = []
        for k, (keys, offset, window) in self.prefix.items():
            own, where = _own_shingles(words, bounds, k)
            low = np.searchsorted(keys, own, "left")
            near = np.flatnonzero((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] == own))
            low, n = low[near], np.searchsorted(keys, own[near], "right") - low[near]
            pick = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(where[near], n)
            for first, w in zip((at - offset[pick]).tolist(), window[pick].tolist()):
                size = int(self.size[w])
                doc = np.searchsorted(bounds, first, "right") - 1
                if first < 0 or doc < 0 or first + size > len(words) or first < bounds[doc]:
                    continue  # positional bound: begins before the document
                if doc + 1 < len(bounds) and first + size > bounds[doc + 1]:
                    continue  # length bound: ends after it
                if (words[first : first + size] != self.hashes[self.first[w] : self.first[w] + size]).any():
                    continue
                if b" ".join(buf[starts[first] : ends[first + size - 1]].split()) == self.text(w):
                    out.append((first, size, w))
        return out


def _lookup(vocab: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(vocab):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(vocab, values), len(vocab) - 1)
    return np.where(vocab[at] == values, at, -1)


def _own_shingles(words, bounds, k):
    """Shingles that lie inside one document, and their first words."""
    own = shingle_hashes(words, k)
    inside = np.ones(len(own), dtype=bool)
    for back in range(1, k):
        cross = bounds - back
        inside[cross[(cross >= 0) & (cross < len(own)) & (bounds > 0)]] = False
    where = np.flatnonzero(inside)
    return own[where], where


def _split(texts: list[bytes], hasher: WordHasher):
    buf, offsets = joined(texts, ALNUM)
    starts, ends, words = hasher(buf)
    return buf, starts, ends, words, np.searchsorted(starts, offsets)


def _counter(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = WordHasher(), None
        for batch in batches:
            for _, texts in text_groups(batch.column(0)):
                _, _, _, words, bounds = _split(texts, hasher)
                got = index.value.count(words, bounds)
                total = got if total is None else {k: total[k] + got[k] for k in got}
        for k, counts in (total or {}).items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), k, dtype=np.int32)), pa.array(at.astype(np.int64)), pa.array(counts[at].astype(np.int64))], ["k", "at", "n"]
            )

    return run


def _scan(index, texts, hasher):
    """For each text: number of words, hit ranges (not merged), item ids."""
    buf, starts, ends, words, bounds = _split(texts, hasher)
    sizes = np.diff(np.append(bounds, len(words))).tolist()
    spans: list[list] = [[] for _ in texts]
    items: list[set] = [set() for _ in texts]
    for first, size, w in index.hits(buf, starts, ends, words, bounds):
        # Empty documents share a bound with their successor; the last one owns the word.
        doc = int(np.searchsorted(bounds, first, "right") - 1)
        spans[doc].append((first - int(bounds[doc]), first - int(bounds[doc]) + size))
        items[doc].update(index.items_of(w))
    return sizes, spans, items


def _merged(spans) -> list[dict]:
    """Ranges in order, touching ones joined."""
    out: list[dict] = []
    for s, e in sorted(spans):
        if out and s <= out[-1]["e"]:
            out[-1]["e"] = max(out[-1]["e"], e)
        else:
            out.append({"s": s, "e": e})
    return out


def _finder(index, *, known: bool, last: bool):
    """Look up one block; rows bring earlier findings if ``known``, and lose their text if ``last``."""
    kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(1)):
                part = batch.slice(first, len(texts))
                n, spans, items = _scan(index.value, texts, hasher)
                if known:
                    spans = [own + [(x["s"], x["e"]) for x in old] for own, old in zip(spans, part.column(3).to_pylist())]
                    items = [own.union(old) for own, old in zip(items, part.column(4).to_pylist())]
                out = [pa.array(n, pa.int64()), pa.array([_merged(x) for x in spans], kind), pa.array([sorted(x) for x in items], pa.list_(pa.string()))]
                before = [part.column(0)] if last else [part.column(0), part.column(1)]
                yield pa.RecordBatch.from_arrays(before + out, (["doc_id"] if last else ["doc_id", "text"]) + ["n_words", "spans", "items"])

    return run


def _cleaner(index, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            for first, texts in text_groups(batch.column(at)):
                _, _, items = _scan(index.value, texts, hasher)
                yield batch.slice(first, len(texts)).filter(pa.array([not x for x in items]))

    return run


def _pieces(words: bytes, window: int, most: int) -> Iterator[bytes]:
    """An item's words (joined by single blanks), cut into pieces of about ``most``
    bytes that overlap by ``window - 1`` words."""
    low = 0
    while len(words) - low > most:
        end = low
        for _ in range(window):  # a window's words at least
            end = words.find(b" ", end + 1) if end >= 0 else end
        end = words.find(b" ", max(end, low + most)) if end >= 0 else end
        if end < 0:
            break
        yield words[low:end]
        low = end
        for _ in range(window - 1):
            low = words.rfind(b" ", 0, low)
        low += 1
    yield words[low:]


def indexes(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, text: str = "text"):
    """Broadcast indexes of the benchmark's blocks, ranked over ``docs``."""
    spark, block, size = docs.sparkSession, [], 0

    def ready(rows):
        index = Index(rows, window)
        sent = Sent(spark, index)
        counts = {k: np.zeros(len(v), dtype=np.int64) for k, v in index.vocab.items()}
        counted = docs.select(F.col(text)).mapInArrow(_counter(sent), "k int, at bigint, n bigint").groupBy("k", "at").agg(F.sum("n").alias("n"))
        for k, at, n in counted.toLocalIterator():  # at most the block's vocabulary
            counts[k][at] = n
        sent.unpersist()
        index.rank(counts)
        return Sent(spark, index)

    rows = benchmark.select(F.col("item_id").cast("string"), F.col(text)).filter(F.col("item_id").isNotNull() & F.col(text).isNotNull())
    for item, value in rows.toLocalIterator():
        words = b" ".join(joined([value.encode()], ALNUM)[0].split())
        # A piece is longer than a window's words unless it is the whole item.
        for piece in _pieces(words, window, block_bytes) if words else ():
            if block and size + len(piece) > block_bytes:
                yield ready(block)
                block, size = [], 0
            block.append((item, piece))
            size += len(piece)
    if block:
        yield ready(block)


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Word ranges and benchmark items found in each document.

    Returns one row per input row: ``doc_id``, ``n_words``, ``spans`` (disjoint
    hit word ranges, end exclusive, ascending) and ``items`` (ids as strings,
    ascending). Null or empty text has no words; items that are null, empty or
    without an id have no windows; repeated items count once per id; an empty
    benchmark finds nothing; an empty table gives no rows. Rows that repeat an id
    or a text stay rows of their own, however many blocks the benchmark fills.
    Other columns of ``docs`` are ignored.
    """
    now = docs.select("doc_id", "text")
    blocks = indexes(now, benchmark, window, block_bytes)
    index, done = next(blocks, None), 0
    if index is None:
        index = Sent(docs.sparkSession, _ranked_empty(window))
    while index is not None:
        more = next(blocks, None)
        now = now.mapInArrow(_finder(index, known=done > 0, last=more is None), FOUND if more is None else _CARRIED)
        index, done = more, done + 1
        if more is not None and done % CHAIN == 0:
            now = cut(now)
    return now


def _ranked_empty(window: int) -> Index:
    index = Index([], window)
    index.rank({})
    return index


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold a benchmark window; all columns stay.

    Rows of null or empty text hold none and stay; repeated rows go or stay alike;
    an empty benchmark drops nothing; an empty table gives no rows.
    """
    kept = docs
    for done, index in enumerate(indexes(docs, benchmark, window, block_bytes)):
        if done and done % CHAIN == 0:
            kept = cut(kept)
        kept = kept.mapInArrow(_cleaner(index, docs.columns.index("text")), docs.schema)
    return kept


def digest(found: DataFrame) -> DataFrame:
    """The result columns of the registered query."""
    n_items = F.size("items").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        F.expr("aggregate(spans, 0L, (a, x) -> a + x.e - x.s)").alias("n_hit"),
        n_items.alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (n_items > 0).alias("contaminated"),
    )


#: Words and windows in DuckDB; window sizes are the distinct ones of the benchmark.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i+k-1], ' ') AS win
       FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i+k-1], ' ') AS win
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
m AS (SELECT DISTINCT doc_id, item_id, dw.k, i FROM dw JOIN bw ON dw.k = bw.k AND dw.win = bw.win),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
