"""Retrieval: inverted index, TF-IDF, Hamming embedding, top-k and evaluation."""

from __future__ import annotations

import gc

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from skein.functions.scalar import hamming_weight, pack_bits
from skein.session import cut, cut_packed, unpack


def idf(postings: DataFrame, doc: str = "doc_id", word: str = "word") -> DataFrame:
    """``ln(N / df)`` of each word; a document has one posting a word."""
    n = postings.agg(F.countDistinct(doc).alias("n"))
    df = postings.groupBy(word).agg(F.count("*").alias("df"))
    return df.crossJoin(F.broadcast(n)).select(word, "df", F.ln(F.col("n") / F.col("df")).alias("idf"))  # one row


def norms(postings: DataFrame, weights: DataFrame) -> DataFrame:
    """Self-similarity of each document (sum of squared idf over its postings) and
    the reciprocal of its root."""
    own = postings.join(weights.select("word", "idf"), "word").groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("self"))
    return own.select("doc_id", "self", F.when(F.col("self") > 0, 1 / F.sqrt("self")).otherwise(F.lit(1.0)).alias("norm"))


def search(queries: DataFrame, postings: DataFrame, k: int = 10, part_rows: int = 4_096) -> DataFrame:
    """The ``k`` best documents of each query by shared words.

    A word adds its squared idf times the root of its count in the document for
    each time the query has it. Scores are multiplied by both norms. The weight of a
    word is joined to the postings once; words of many documents are dealt by document
    into parts of about ``part_rows`` postings, so that no word is one task's. Words in
    every document weigh nothing and are left out.
    """
    postings = cut(postings)
    weights = cut(idf(postings).filter("idf > 0").withColumn("parts", F.ceil(F.col("df") / part_rows).cast("long")))
    # Postings meet the weights by word and part too: a weight is copied for each part.
    frequent = F.broadcast(weights.filter("parts > 1").select("word", "parts")) if weights.filter("parts > 1").limit(1_000_001).count() <= 1_000_000 else weights.filter("parts > 1").select("word", "parts")
    dealt = postings.join(frequent, "word", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("doc_id"), "parts"), F.lit(0).cast("long"))).drop("parts")
    each = weights.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    there = cut(dealt.join(each.select("word", "part", "idf"), ["word", "part"]))
    asked = queries.join(each.select("word", "part", F.col("idf").alias("qidf")), "word")
    value = F.col("qtf") * F.col("idf") * F.col("idf") * F.sqrt("tf")
    hits = asked.join(there, ["word", "part"]).groupBy("query_id", "doc_id").agg(F.sum(value).alias("score"))
    self_ = there.groupBy("doc_id").agg(F.sum(F.col("tf") * F.col("idf") * F.col("idf")).alias("self"))
    own = asked.filter("part = 0").groupBy("query_id").agg(F.sum(F.col("qtf") * F.col("qidf") * F.col("qidf")).alias("qself"))
    scored = hits.join(self_, "doc_id").join(own, "query_id")
    scored = scored.withColumn("score", F.round(F.col("score") * (1 / F.sqrt("self")) / F.sqrt("qself"), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score")


#: Postings of a part of the words or documents, documents of a word's list that stay together.
_POSTINGS, _LIST = 500_000, 65_536
#: Hits of a block of queries, and of those that are listed at a time (they stay in a core's cache).
_HITS, _STEP = 6_000_000, 100_000
#: Entries of lists that are on their way to blocks at a time (about ten bytes each).
_SENT_ENTRIES = 60_000_000


def _blob(**columns: np.ndarray) -> bytes:
    """Columns in the given order, compressed."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    how = {n: "BYTE_STREAM_SPLIT" if c.dtype.kind == "f" else "DELTA_BINARY_PACKED" for n, c in columns.items()}
    out = pa.BufferOutputStream()
    pq.write_table(pa.table(columns), out, compression="zstd", write_statistics=False, use_dictionary=False, column_encoding=how)
    return out.getvalue().to_pybytes()


def _columns(blobs) -> dict[str, np.ndarray]:
    """Columns of one blob after the other."""
    import pyarrow as pa

    table = pa.concat_tables([unpack(b) for b in blobs])
    return {n: table.column(n).to_numpy() for n in table.column_names}


def _by(key: np.ndarray, columns: dict[str, np.ndarray]):
    """A row (key, blob) for each key; the key is the first column of the batch."""
    import pyarrow as pa

    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
    keys, blobs = [], []
    for i, j in zip(cuts, [*cuts[1:], len(key)]):
        keys.append(int(key[order[i]]))
        blobs.append(_blob(**{n: c[order[i:j]] for n, c in columns.items()}))
    return pa.table({"at": pa.array(keys, pa.int64()), "blob": pa.array(blobs, pa.binary())})


def _word_part(word: np.ndarray, part, parts: int) -> np.ndarray:
    x = (word.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.asarray(part + 1).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(parts)).astype(np.int64)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _let_go(spark) -> None:
    """Files of shuffles and stored tables that nothing names any more go when the driver
    collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def similar_documents(postings: DataFrame, k: int) -> DataFrame:
    """``search`` of every document, itself included, where ids, words and counts are integers.

    Hits are not shuffled. Documents are dealt by ranges of ids into blocks of about
    ``_HITS`` hits; a word's list is sent once to a block that asks for it, as compressed
    columns, and all hits of a document are met where it is. Where the lists are more than
    ``_SENT_ENTRIES``, some blocks are done after the others. Lists of words of many
    documents are cut.
    """
    spark = postings.sparkSession
    # Postings without a word count as their document alone, those without one as their word's.
    tf = F.when(F.col("word").isNull(), F.lit(-2)).when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.col("tf")).cast("long")
    rows = cut_packed(postings.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0).cast("long")).alias("doc"), F.coalesce(F.col("word").cast("long"), F.lit(0).cast("long")).alias("word"), tf.alias("tf")))
    total, n = rows.agg(F.count("*"), F.countDistinct(F.when(F.col("tf") != -1, F.col("doc")))).first()
    empty = spark.createDataFrame([], "query_id bigint, doc_id bigint, rank int, score double")
    if not total:
        return empty
    parts = -(-total // _POSTINGS)
    some = sorted(r[0] for r in rows.filter("tf >= 0").select("doc").sample(min(1.0, 100 * parts / total), 1).collect())
    bounds = np.unique(np.array([some[len(some) * i // parts] for i in range(1, parts)] if some else [], dtype=np.int64))

    def split(batches):  # by words
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= _POSTINGS:
                yield from done(held)
                held, size = [], 0
        if size:
            yield from done(held)

    def done(held):
        c = {x: np.concatenate([b.column(x).to_numpy() for b in held]) for x in ("word", "doc", "tf")}
        c = {x: v[c["tf"] != -2] for x, v in c.items()}
        if len(c["word"]):
            yield from _by(_word_part(c["word"], 0, parts), c).to_batches()

    def weigh(table):  # a part of the words, to ranges of documents
        c = _columns(table.column("blob").to_pylist())
        _, at, df = np.unique(c["word"], return_inverse=True, return_counts=True)
        c |= {"df": df[at], "idf": np.log(n / df)[at]}
        c = {x: v[(c["tf"] >= 0) & (c["idf"] > 0)] for x, v in c.items()}
        return _by(np.searchsorted(bounds, c["doc"], side="right"), c)

    def norm(table):  # a range of documents, back to parts of the words
        c = _columns(table.column("blob").to_pylist())
        order = np.lexsort((c["word"], c["doc"]))
        c = {x: v[order] for x, v in c.items()}
        first = np.flatnonzero(np.diff(c["doc"], prepend=c["doc"][0] - 1))
        size = np.diff(first, append=len(order))
        c["self"] = np.repeat(np.add.reduceat(c["tf"] * c["idf"] * c["idf"], first), size)
        cost = np.cumsum(np.add.reduceat(c["df"], first))
        blocks = -(-int(cost[-1]) // _HITS)
        c["block"] = (table.column("at")[0].as_py() << 32) + np.repeat((cost - 1) * blocks // cost[-1], size)
        many = -(-c.pop("df") // _LIST)
        c["part"] = c["doc"] % many  # a list's entry is in one part, who asks in each
        c["role"] = np.where(many > 1, 1, 3)
        asks = np.repeat(np.flatnonzero(many > 1), many[many > 1])
        if len(asks):
            more = {x: v[asks] for x, v in c.items()}
            more["part"], more["role"] = _ranges(np.zeros(int((many > 1).sum()), np.int64), many[many > 1]), np.full(len(asks), 2)
            c = {x: np.concatenate([v, more[x]]) for x, v in c.items()}
        return _by(_word_part(c["word"], c["part"], parts), c)

    def sort(table):
        c = _columns(table.column("blob").to_pylist())
        order = np.lexsort((c["doc"], c["part"], c["word"]))
        return _by(np.full(len(order), table.column("at")[0].as_py()), {x: v[order] for x, v in c.items()})

    pair = "at bigint, blob binary"
    grouped = lambda df, size: df.repartition(max(1, min(10_000, size)), "at").groupBy("at")  # noqa: E731 by number: few bytes are much work
    weighed = grouped(rows.mapInArrow(split, pair), 2 * parts).applyInArrow(weigh, pair)
    lists = cut(grouped(grouped(weighed, 2 * parts).applyInArrow(norm, pair), 2 * parts).applyInArrow(sort, pair))

    del rows, weighed
    _let_go(spark)

    def asked(c):
        """Who asks, by block and list; each list's entries, first of them and number."""
        new = (np.diff(c["word"], prepend=c["word"][0]) != 0) | (np.diff(c["part"], prepend=c["part"][0]) != 0)
        which, entries = np.cumsum(new), np.flatnonzero(c["role"] & 1)
        size = np.bincount(which[entries], minlength=which[-1] + 1)
        who = np.flatnonzero(c["role"] & 2)
        who = who[np.lexsort((which[who], c["block"][who]))]
        starts = np.flatnonzero((np.diff(which[who], prepend=-1) != 0) | (np.diff(c["block"][who], prepend=-1) != 0))
        return which, entries, np.cumsum(size) - size, size, who, starts

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            for blob in batch.column("blob").to_pylist():
                c = _columns([blob])
                which, _, _, size, who, starts = asked(c)
                blocks, at = np.unique(c["block"][who[starts]], return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(blocks), pa.array(np.bincount(at, size[which[who[starts]]]).astype(np.int64))], ["block", "n"])

    def send(first, last):
        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for at, blob in zip(batch.column("at").to_pylist(), batch.column("blob").to_pylist()):
                    c = _columns([blob])
                    which, entries, begin, size, who, starts = asked(c)
                    blocks = c["block"][who]
                    lo, hi = np.searchsorted(blocks, first), np.searchsorted(blocks, last, side="right")
                    edges = lo + np.flatnonzero(np.diff(blocks[lo:hi], prepend=-1))
                    for i, j in zip(edges, [*edges[1:], hi]):
                        a, own = who[i:j], starts[np.searchsorted(starts, i) : np.searchsorted(starts, j)]
                        g = which[who[own]]
                        e = entries[_ranges(begin[g], size[g])]
                        asks = _blob(list=np.repeat(np.arange(len(own)), np.diff(own, append=j)), doc=c["doc"][a], tf=c["tf"][a], self=c["self"][a], idf=c["idf"][a])
                        there = _blob(doc=c["doc"][e], tf=c["tf"][e], self=c["self"][e])
                        yield pa.RecordBatch.from_arrays([pa.array([int(blocks[i])]), pa.array([at]), pa.array([asks], pa.binary()), pa.array([_blob(size=size[g])], pa.binary()), pa.array([there], pa.binary())], ["at", "part", "asks", "sizes", "lists"])

        return run

    def best(table):
        import pyarrow as pa

        table = table.sort_by("part")
        each = [(unpack(a), unpack(z).column("size").to_numpy()) for a, z in zip(table.column("asks").to_pylist(), table.column("sizes").to_pylist())]
        there = _columns(table.column("lists").to_pylist())
        a = {x: np.concatenate([t.column(x).to_numpy() for t, _ in each]) for x in ("doc", "tf", "self", "idf")}
        lists = np.concatenate([t.column("list").to_numpy() + base for (t, _), base in zip(each, np.cumsum([0] + [len(z) for _, z in each]))])
        size = np.concatenate([z for _, z in each])
        begin = (np.cumsum(size) - size)[lists]
        size = size[lists]
        order = np.argsort(a["doc"], kind="stable")
        a, begin, size = {x: v[order] for x, v in a.items()}, begin[order], size[order]
        value, root = a["tf"] * a["idf"] * a["idf"], np.sqrt(there["tf"])
        ends = np.append(np.flatnonzero(np.diff(a["doc"], prepend=a["doc"][0] - 1)), len(order))
        query = np.cumsum(np.diff(a["doc"], prepend=a["doc"][0]) != 0)
        names, docs = np.unique(there["doc"], return_inverse=True)
        total, out, i = np.concatenate([[0], np.cumsum(size)]), [], 0
        while i < len(ends) - 1:
            # Whole queries, of about _STEP hits.
            j = max(i + 1, int(np.searchsorted(total[ends], total[ends[i]] + _STEP, side="right")) - 1)
            lo, hi = ends[i], ends[j]
            row, entry = np.repeat(np.arange(lo, hi), size[lo:hi]), _ranges(begin[lo:hi], size[lo:hi])
            key = query[row] * len(names) + docs[entry]
            order = np.argsort(key)
            cuts = np.flatnonzero(np.diff(key[order], prepend=-1))
            score = np.add.reduceat((value[row] * root[entry])[order], cuts)
            row, entry = row[order[cuts]], entry[order[cuts]]
            score = np.floor(score * (1 / np.sqrt(there["self"][entry])) / np.sqrt(a["self"][row]) * 1e6 + 0.5)
            # Hits are in the order of queries and documents, which holds where scores are equal.
            whose = query[row] - query[lo]
            order = np.argsort(((whose + 1) << 40) - score.astype(np.int64), kind="stable") if score.max() < 1 << 40 and whose[-1] < 1 << 22 else np.lexsort((-score, whose))
            row, entry, score = row[order], entry[order], score[order]
            start = np.flatnonzero(np.diff(query[row], prepend=-1))
            rank = np.arange(len(row)) - np.repeat(start, np.diff(start, append=len(row))) + 1
            top = rank <= k
            out.append(pa.table({"query_id": a["doc"][row[top]], "doc_id": there["doc"][entry[top]], "rank": rank[top].astype(np.int32), "score": score[top] / 1e6}))
            i = j
        return pa.concat_tables(out)

    sizes = lists.mapInArrow(count, "block bigint, n bigint").groupBy("block").agg(F.sum("n").alias("n")).orderBy("block").collect()  # a row a block
    turns, held = [], 0
    for r in sizes:
        if not turns or held + r["n"] > _SENT_ENTRIES:
            turns, held = [*turns, []], 0
        turns[-1].append(r["block"])
        held += r["n"]
    found = empty
    for i, turn in enumerate(turns):
        sent = lists.mapInArrow(send(turn[0], turn[-1]), "at bigint, part bigint, asks binary, sizes binary, lists binary")
        some = grouped(sent, 2 * len(turn)).applyInArrow(best, empty.schema)
        found = some if len(turns) == 1 else found.unionByName(cut_packed(some))
        if i < len(turns) - 1:
            del sent, some
            _let_go(spark)
    return found


def similarity_graph(postings: DataFrame, k: int = 100) -> DataFrame:
    """Every document asked for its ``k`` best others: (src < dst, weight), the weight
    being the score times 1000, cut to an integer. Each document finds itself first,
    which is why one more is asked for."""
    if all(kind in ("tinyint", "smallint", "int", "bigint") for _, kind in postings.select("doc_id", "word", "tf").dtypes):
        found = similar_documents(postings, k + 1)
    else:
        found = search(postings.select(F.col("doc_id").alias("query_id"), "word", F.col("tf").alias("qtf")), postings, k + 1)
    return found.filter("query_id < doc_id").select(F.col("query_id").alias("src"), F.col("doc_id").alias("dst"), F.floor(F.col("score") * 1000).cast("int").alias("weight"))


def loop_pairs(samples: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """Pairs of sampled images (image_id) with their ``k`` most similar ones."""
    from .pairs import distinct_pairs

    queries = postings.join(samples.select(F.col("image_id").alias("doc_id")), "doc_id", "left_semi").select(F.col("doc_id").alias("query_id"), "word", F.col("tf").alias("qtf"))
    found = search(queries, postings, k + 1)
    return distinct_pairs(found.select(F.col("query_id").alias("image_id1"), F.col("doc_id").alias("image_id2")))


def rerank(found: DataFrame, verified: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of (query_id, vec_id, score) after verification: scores plus the
    verified ones' ``inliers``; candidates that were not verified keep their score."""
    rows = found.select("query_id", "vec_id", "score").join(verified.select("query_id", "vec_id", "inliers"), ["query_id", "vec_id"], "left")
    rows = rows.withColumn("score", F.round(F.col("score") + F.coalesce("inliers", F.lit(0)), 6))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", "score")


INDEX = ("words", "postings", "signatures")


def write_index(path: str, **tables: DataFrame) -> None:
    """A visual index: ``words`` (word, centre), ``postings`` (doc_id, word, tf) and
    ``signatures`` (image_id, word, sig), each a Parquet table below one path."""
    for name, rows in tables.items():
        if name not in INDEX:
            raise ValueError(f"an index has {INDEX}, not {name!r}")
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_index(spark, path: str) -> dict[str, DataFrame]:
    """The tables of an index that are there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [n for n in INDEX if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{n}/_SUCCESS"))]
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in there}


# Visual words ---------------------------------------------------------------------------


def assign_words(vectors: DataFrame, centres: np.ndarray, neighbours: int = 1) -> DataFrame:
    """(vec_id, word, rank): the nearest centres of each vector, exactly.

    The vocabulary is trained on a bounded sample, so its size is a parameter and
    not the data's; it is sent to the executors and met by matrix products.
    """
    import pyarrow as pa

    sent = vectors.sparkSession.sparkContext.broadcast(np.asarray(centres, dtype=np.float64))

    def run(batches):
        c = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
            d = -2 * flat @ c.T + (c**2).sum(axis=1)
            best = np.argsort(d, axis=1, kind="stable")[:, :neighbours]
            n = best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(batch.column(0).to_numpy(), n)), pa.array(best.reshape(-1), pa.int32()), pa.array(np.tile(np.arange(1, n + 1, dtype=np.int32), len(best)))], ["vec_id", "word", "rank"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id bigint, word int, rank int")


def vocabulary(vectors: DataFrame, words: int, *, sample: int = 50_000, branching: int = 16, seed: int = 0) -> np.ndarray:
    """Centres from hierarchical k-means over a bounded sample."""
    from .partition import kmeans

    n = vectors.count()
    some = vectors.select("vec_id", "embedding").filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(min(1.0, sample / max(1, n)) * (1 << 30)) + 1).toPandas().sort_values("vec_id")
    points = np.array(some["embedding"].tolist(), dtype=np.float64)
    parts = [points]
    while len(parts) < words:
        parts.sort(key=len, reverse=True)
        largest = parts.pop(0)
        k = min(branching, words - len(parts), len(np.unique(largest, axis=0)))
        if k < 2:
            parts.append(largest)
            break
        label = kmeans(largest, k, rounds=10, seed=seed)
        parts += [largest[label == j] for j in range(k) if (label == j).any()]
    return np.array([p.mean(axis=0) for p in parts])


def projection(dimensions: int, bits: int = 64, seed: int = 0) -> np.ndarray:
    """A random orthogonal projection (its first ``bits`` rows)."""
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(max(dimensions, bits), max(dimensions, bits))))
    return q[:bits, :dimensions]


def thresholds(rows: DataFrame, least: int = 5) -> DataFrame:
    """Median of each dimension in each word with at least ``least`` vectors."""
    each = rows.select("word", F.posexplode("embedding").alias("dim", "v"))
    own = each.groupBy("word", "dim").agg(F.median(F.col("v").cast("double")).alias("t"), F.count("*").alias("n")).filter(F.col("n") >= least)
    return own.groupBy("word").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "t"))), lambda x: x["t"]).alias("t"))  # one entry a dimension


def signatures(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """64-bit signatures: dimension above its word's threshold."""
    return rows.join(limits, "word").select("vec_id", "word", pack_bits(F.transform(F.arrays_zip("embedding", "t"), lambda x: x["embedding"] > x["t"])).alias("sig"))


def hamming_scores(queries: DataFrame, index: DataFrame, weights: DataFrame, most: int = 24) -> DataFrame:
    """Scores (query_id, image_id): per query feature and word, the Hamming weights
    of an image's entries over the root of the votes, times squared idf; summed."""
    pairs = queries.join(index, "word").withColumn("h", F.bit_count(F.col("qsig").bitwiseXOR(F.col("sig")))).filter(F.col("h") <= most)
    votes = pairs.groupBy("query_id", "qfeature", "word", "image_id").agg(F.sum(hamming_weight(F.col("h"))).alias("w"), F.count("*").alias("n"))
    return votes.join(weights.select("word", "idf"), "word").groupBy("query_id", "image_id").agg(F.sum(F.col("w") / F.sqrt("n") * F.col("idf") * F.col("idf")).alias("score"))


def add_images(index: DataFrame, rows: DataFrame) -> DataFrame:
    """Index entries of images that are not in the index yet."""
    return index.unionByName(rows.join(index.select("image_id").distinct(), "image_id", "left_anti"))


# Dense descriptors ------------------------------------------------------------------------


def similarities(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The ``k`` largest inner products of each query (query_id, vec_id, rank, score).

    The query set is stated and met in blocks: up to 4096 queries are sent to
    every batch of vectors, whose best ``k`` per query are merged by a window.
    """
    import pyarrow as pa

    spark, parts = vectors.sparkSession, []

    def scorer(sent):
        def run(batches):
            own, q = sent.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids = batch.column(0).to_numpy()
                product = q @ batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1).astype(np.float64).T
                for i, row in enumerate(product):
                    near = np.lexsort((ids, -np.round(row, 6)))[: k + 1]
                    near = near[ids[near] != own[i]][:k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(near), own[i])), pa.array(ids[near]), pa.array(row[near])], ["query_id", "vec_id", "score"])

        return run

    block: list = []

    def send():
        own = np.array([r[0] for r in block])
        sent = spark.sparkContext.broadcast((own, np.array([r[1] for r in block], dtype=np.float64)))
        parts.append(vectors.select("vec_id", "embedding").mapInArrow(scorer(sent), "query_id bigint, vec_id bigint, score double"))
        block.clear()

    for row in queries.select("vec_id", "embedding").toLocalIterator():
        block.append((row[0], row[1]))
        if len(block) == 4096:
            send()
    if block:
        send()
    if not parts:
        return spark.createDataFrame([], "query_id bigint, vec_id bigint, rank int, score double")
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two array columns, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def region_similarity(pairs: DataFrame, how: str = "sum", regions: int = 4) -> Column:
    """For each query region the best region of the other; their sum or maximum.

    ``q`` and ``v`` are arrays cut into equal regions.
    """
    size = F.size("q") / regions
    part = lambda c, i: F.slice(F.col(c), (i * size + 1).cast("int"), size.cast("int"))
    best = F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda i: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(regions - 1)), lambda j: dot(part("q", i), part("v", j)))))
    return F.aggregate(best, F.lit(0.0), lambda s, x: s + x) if how == "sum" else F.array_max(best)


def expanded_queries(found: DataFrame, vectors: DataFrame, top: int = 10) -> DataFrame:
    """Query vectors replaced by the normalised mean of themselves and their best
    ``top`` results: (vec_id, embedding)."""
    best = found.filter(F.col("rank") <= top).select("query_id", "vec_id").unionByName(found.select("query_id", F.col("query_id").alias("vec_id")).distinct())
    each = best.join(vectors.select("vec_id", "embedding"), "vec_id").select("query_id", F.posexplode("embedding").alias("dim", "v"))
    mean = each.groupBy("query_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("v"))
    own = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("e"))  # one entry a dimension
    length = F.sqrt(dot(F.col("e"), F.col("e")))
    return own.select(F.col("query_id").alias("vec_id"), F.transform("e", lambda x: x / length).alias("embedding"))


def whitening(vectors: DataFrame, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and PCA-whitening matrix; the covariance is summed by the executors."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                flat = np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).reshape(-1)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

    rows = vectors.select("embedding").mapInArrow(run, "i bigint, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas().sort_values("i")["v"].to_numpy()
    d = int((np.sqrt(4 * len(rows) - 3) - 1) / 2)
    n, mean = rows[0], rows[1 : d + 1] / rows[0]
    values, basis = np.linalg.eigh(rows[d + 1 :].reshape(d, d) / n - np.outer(mean, mean))
    order = np.argsort(-values)[:dimensions]
    return mean, (basis[:, order] / np.sqrt(np.maximum(values[order], 1e-12))).T


# Evaluation --------------------------------------------------------------------------------


def average_precision(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Average precision of each query with ground truth, by the trapezoid rule.

    ``found``: (query_id, vec_id, rank); ``truth``: (query_id, vec_id).
    """
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("size"))
    rows = found.join(truth.withColumn("hit", F.lit(1)), ["query_id", "vec_id"], "left").na.fill(0, ["hit"]).join(sizes, "query_id")
    order = Window.partitionBy("query_id").orderBy("rank")
    rows = rows.withColumn("hits", F.sum("hit").over(order)).withColumn("recall", F.col("hits") / F.col("size")).withColumn("precision", F.col("hits") / F.col("rank"))
    before = lambda c, d: F.coalesce(F.lag(c).over(order), F.lit(d))
    rows = rows.withColumn("part", (F.col("recall") - before("recall", 0.0)) * (before("precision", 1.0) + F.col("precision")) / 2)
    return sizes.select("query_id").join(rows.groupBy("query_id").agg(F.sum("part").alias("ap")), "query_id", "left").select("query_id", F.round(F.coalesce("ap", F.lit(0.0)), 6).alias("ap"))


# Feature matching ----------------------------------------------------------------------------


def best_two(pairs: DataFrame) -> DataFrame:
    """Best and second-best partner of each feature by ``score`` (larger is nearer)."""
    order = Window.partitionBy("a").orderBy(F.desc(F.round("score", 6)), "b")
    ranked = pairs.withColumn("_r", F.row_number().over(order)).filter("_r <= 2")
    return ranked.groupBy("a").agg(F.max(F.when(F.col("_r") == 1, F.col("b"))).alias("b"), F.max(F.when(F.col("_r") == 1, F.col("score"))).alias("best"), F.max(F.when(F.col("_r") == 2, F.col("score"))).alias("second"))


def ratio_matches(pairs: DataFrame, ratio: float = 0.8, distance: float = 0.7) -> DataFrame:
    """Matches whose angle passes the distance bound and the ratio test."""
    angle = lambda c: F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col(c))))
    rows = best_two(pairs).withColumn("d1", angle("best")).withColumn("d2", F.coalesce(angle("second"), F.lit(3.141592653589793)))
    return rows.filter((F.col("d1") <= distance) & (F.col("d1") < ratio * F.col("d2"))).select("a", "b", F.round("d1", 6).alias("distance"))


#: Features of a block; the scores of two blocks are held at a time (32 MB of doubles).
_FEATURES = 2_048
#: Features of one side of a task, about.
_PART = 50_000
#: What a matrix product can be off of a sum in order, for vectors of moderate length.
_NEAR = 1e-9


def _exact(q: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Inner products row by row, added in order as ``dot`` adds them."""
    out = np.zeros(len(q))
    for i in range(q.shape[1]):
        out = out + q[:, i] * w[:, i]
    return out


def _two(q: np.ndarray, w: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, column's id, exact score) of the best two columns of each row, ordered as by
    ``best_two``: the product finds what may be among them, which is then added up in order."""
    most = scores.max(axis=1) if scores.shape[1] < 3 else np.partition(scores, -2, axis=1)[:, -2]
    low = most - (2e-6 + _NEAR * np.maximum(1, np.abs(most))) if scores.shape[1] > 2 else np.full(len(q), -np.inf)
    row, col = np.nonzero(scores >= low[:, None])
    score = _exact(q[row], w[col])
    order = np.lexsort((ids[col], -_rounded(score), row))
    row, col, score = row[order], col[order], score[order]
    few = np.arange(len(row)) - np.searchsorted(row, row) < 2
    return row[few], ids[col[few]], score[few]


def _rounded(score: np.ndarray) -> np.ndarray:
    """Six places, halves away from zero, as SQL rounds."""
    from decimal import ROUND_HALF_UP, Decimal

    out = np.round(score, 6)
    part = np.abs(score) * 1e6
    for i in np.flatnonzero(np.abs(part - np.floor(part) - 0.5) < 1e-6):
        out[i] = float(Decimal(repr(float(score[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def nearest_by_blocks(a: DataFrame, b: DataFrame, block: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The best two partners of each feature, from both sides: (a, b, score) and the same
    with the sides swapped. ``a``: (a, q, k), ``b``: (b, w, k); features of one ``k`` meet.

    Features are dealt into parts of about ``_PART``, each two parts are one task, which
    meets them by matrix products of ``block`` features, and only what may be among the best two
    of a block leaves the task.
    """
    import pyarrow as pa

    block = block or _FEATURES
    sides = [df.select(F.col("k").cast("long").alias("k"), F.col(i).cast("long").alias(i), F.col(v).cast("array<float>").alias(v)).dropna() for df, i, v in ((a, "a", "q"), (b, "b", "w"))]
    parts = [max(2, -(-df.count() // _PART)) for df in sides]
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = sides[0].withColumn("x", deal("a", parts[0])).withColumn("y", each(parts[1]))
    right = sides[1].withColumn("y", deal("b", parts[1])).withColumn("x", each(parts[0]))
    schema = pa.schema([("back", pa.bool_()), ("a", pa.int64()), ("b", pa.int64()), ("score", pa.float64())])

    def run(one: pa.Table, two: pa.Table) -> pa.Table:
        out = []
        if one.num_rows and two.num_rows:
            (xi, x), (yi, y) = ((t.column(i).to_numpy(), t.column(v).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1).astype(np.float64)) for t, i, v in ((one, "a", "q"), (two, "b", "w")))
            for i in range(0, len(x), block):
                for j in range(0, len(y), block):
                    q, w, qi, wj = x[i : i + block], y[j : j + block], xi[i : i + block], yi[j : j + block]
                    scores = q @ w.T
                    for back, own, (at, other, score) in ((False, qi, _two(q, w, wj, scores)), (True, wj, _two(w, q, qi, scores.T))):
                        out.append(pa.table([pa.array(np.full(len(at), back)), pa.array(own[at]), pa.array(other), pa.array(score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    keys = ("k", "x", "y")
    found = cut(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "back boolean, a bigint, b bigint, score double"))
    return found.filter("NOT back").drop("back"), found.filter("back").drop("back")


def mutual_matches_by_blocks(a: DataFrame, b: DataFrame, ratio: float = 0.8, distance: float = 0.7) -> DataFrame:
    """``mutual_matches`` of all pairs of one ``k``, which are never listed."""
    there, back = nearest_by_blocks(a, b)
    back = ratio_matches(back, ratio, distance)
    return ratio_matches(there, ratio, distance).join(back.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def mutual_matches(pairs: DataFrame, ratio: float = 0.8, distance: float = 0.7) -> DataFrame:
    """Ratio matches that hold from both sides."""
    back = ratio_matches(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "score"), ratio, distance)
    return ratio_matches(pairs, ratio, distance).join(back.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_semi")


def guided(pairs: DataFrame, residual: Column, most: float) -> DataFrame:
    """Candidate pairs that agree with a geometry, for matching among them only."""
    return pairs.filter(residual <= most)


def top_scale(features: DataFrame, n: int) -> DataFrame:
    """The features of largest scale of each image."""
    order = Window.partitionBy("image_id").orderBy(F.desc("scale"), "idx")
    return features.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_r")
