"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame only).

1. Sources in code-point order get cyclic weights; the mix holds ``share`` times
   all words; a target stops at ``repeats`` times its source's size and the
   excess is shared again by weight (water filling, closed form over the sorted
   caps).
2. Each source's documents are dealt by hash into cells (shards) of about
   ``cell_words`` words, so a hot source has more cells, not larger ones.
3. Blocks of ``block_words`` words are allocated to sources by highest
   quotients target / (2k + 1), then each source's blocks to its cells by
   highest quotients cell size / (2k + 1): integer quotas per cell.
4. A cell's documents stand in seeded order as one stream of blocks; its quota
   of blocks is taken from a seeded starting block on, round the stream, at
   most ``repeats`` times. A document's taken words are its overlap.

Only (id, source, size) rows are shuffled, never texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded, by_key, cut

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK_WORDS = 16
CELL_WORDS = 1_000_000
SEED = "mix-1"

_WORD, _BLANKS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r"


def n_words(text: Column) -> Column:
    """Number of runs of non-blanks; a run becomes one character, blanks go."""
    return F.coalesce(F.length(F.translate(F.regexp_replace(text, _WORD, "x"), _BLANKS, "")), F.lit(0)).cast("long")


def seeded(*parts: Column) -> Column:
    """A non-negative 60-bit hash that other SQL engines can reproduce."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def accumulated(df: DataFrame, order: list[str], **values: Column) -> DataFrame:
    """Add for each name the sum of a value over all rows before, in a total order,
    and ``_at``, the row's position from 0.

    Rows are range-partitioned and sorted; a partition adds up its own rows and what
    the partitions before it hold (one row a partition), so no task sees them all.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = cut(ranged.select("*", *[v.alias(f"_v_{k}") for k, v in values.items()], F.lit(1).cast("long").alias("_v__at"), F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_row")))
    names = [*values, "_at"]
    parts = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(*[F.sum(f"_v_{k}").alias(f"_s_{k}") for k in names])
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_s_{k}").over(parts), F.lit(0)).alias(f"_b_{k}") for k in names])
    own = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(sums), "_part")
    return out.select(*df.columns, *[(F.col(f"_b_{k}") + F.coalesce(F.sum(f"_v_{k}").over(own), F.lit(0))).alias(k) for k in names])


def sainte_lague(df: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Add ``out``: the seats of each row, by highest quotients votes / (2k + 1).

    ``seats`` is constant within a group. With n rows, V votes and S seats, a
    row's seats lie between those of the divisors V / (S - n/2) and
    V / (S + n/2), so only about two quotients a row are ranked. All groups are
    ranked in one distributed sort, so that a group of any size is not one task's.
    Equal quotients go to the smaller ``key``; rows without votes get none.
    """
    v, s = F.col(votes).cast("double"), F.col(seats)
    totals = df.groupBy(*group).agg(F.sum(v).alias("_v"), F.sum((v > 0).cast("int")).alias("_n"))
    df = df.join(bounded(cut(totals)), group) if group else df.crossJoin(F.broadcast(totals))  # one row
    low = F.greatest(F.lit(0), F.floor(v * (s - F.col("_n") / 2) / F.col("_v") - 0.5) - 1)
    high = F.floor(v * (s + F.col("_n") / 2) / F.col("_v") + 0.5) + 1
    has = (v > 0) & (s > 0)
    df = cut(df.withColumn("_low", F.when(has, low).otherwise(F.lit(0)).cast("long")).withColumn("_high", F.when(has, high).otherwise(F.lit(0)).cast("long")).drop("_v", "_n"))
    quotients = df.filter("_high > _low").select(*group, key, F.col(votes).alias("_votes"), F.explode(F.sequence("_low", F.col("_high") - 1)).alias("_k"))
    quotients = quotients.withColumn("_q", -F.col("_votes") / (2 * F.col("_k") + 1))
    ranked = accumulated(quotients, [*group, "_q", key, "_k"])
    bounds = df.groupBy(*group).agg((F.max(s) - F.sum("_low")).alias("_rest")) if group else df.agg((F.max(s) - F.sum("_low")).alias("_rest"))
    if group:
        first = ranked.groupBy(*group).agg(F.min("_at").alias("_first"))
        ranked = ranked.join(bounded(cut(first.join(bounds, group))), group)
    else:
        ranked = ranked.crossJoin(F.broadcast(bounds)).withColumn("_first", F.lit(0))
    won = ranked.filter(F.col("_at") - F.col("_first") < F.col("_rest")).groupBy(*group, key).agg(F.count("*").alias("_won"))
    return df.join(won, [*group, key], "left").withColumn(out, F.col("_low") + F.coalesce("_won", F.lit(0))).drop("_low", "_high", "_won")


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Add ``weight`` and ``target`` to rows (source, source_size); any number of sources."""
    placed = accumulated(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"]).drop("_null")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * float(repeats)
    df = placed.withColumn("weight", weight).drop("_at").withColumn("_ratio", F.col("source_size") / F.col("weight")).withColumn("_null", F.col("source").isNull())
    df = accumulated(df, ["_ratio", "_null", "source"], _capped=cap, _before=F.col("weight"))
    whole = df.agg(F.sum("source_size").alias("_all"), F.sum("weight").alias("_weights"))
    df = df.crossJoin(F.broadcast(whole))  # one row
    # Were this source the first below its cap, the level per unit of weight would be:
    level = (F.col("_all") * F.lit(float(share)) - F.col("_capped")) / (F.col("_weights") - F.col("_before"))
    df = cut(df.withColumn("_level", level))
    reached = df.filter(F.col("_level") * F.col("weight") <= cap).agg(F.min_by("_level", "_at").alias("_reached"))
    df = df.crossJoin(F.broadcast(reached))  # one row
    return df.withColumn("target", F.least(cap, F.coalesce(F.col("_reached") * F.col("weight"), cap))).select(*sources.columns, "weight", "target")


def mix(docs: DataFrame, *, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, cell_words: int = CELL_WORDS) -> DataFrame:
    """How many words of each document the mix takes.

    Returns one row per input row: ``doc_id``, ``source``, ``size``,
    ``source_size``, ``target`` (its source's) and ``taken`` (repeats counted, at
    most ``repeats`` times the size). Null and blank texts have size 0 and none
    taken; a null source is a source of its own, last in order; rows without an id
    are dealt by their texts; repeated rows are rows of their own; an empty table
    gives no rows. Other columns are
    ignored.
    """
    key = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n"))
    # Rows without an id are told apart by their texts, or they would all fall into one cell.
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("n"), F.md5(F.coalesce(F.col("text"), F.lit("")))))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), name.alias("_name")).withColumn("_key", key)
    sized = cut(sized.withColumn("_h", seeded(F.col("_name"), F.col("_key"))).drop("_name"))
    sources = cut(sized.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows")))
    total = sources.agg(F.sum("_rows")).first()[0] or 0
    sources = targets(sources, weights, share, repeats)
    seats = sources.agg(F.round(F.sum("target") / block_words).cast("long").alias("_seats"))
    sources = sources.crossJoin(F.broadcast(seats))  # one row
    sources = sainte_lague(sources, [], "_key", "target", "_seats", "_blocks")
    sources = sources.withColumn("_cells", F.ceil(F.col("source_size") / F.lit(cell_words)).cast("long"))
    sources = cut(sources.select("_key", "source_size", "target", "_blocks", F.greatest(F.lit(1), "_cells").alias("_cells"), "_rows"))

    # A hot source would be one key of a shuffled join.
    dealt = by_key(sized, sources, "_key", "_rows", total).withColumn("_cell", F.pmod("_h", "_cells"))
    cells = dealt.groupBy("_key", "_cell").agg(F.sum("size").alias("_cell_size"), F.first("_blocks").alias("_blocks"))
    cells = sainte_lague(cells, ["_key"], "_cell", "_cell_size", "_blocks", "_quota")
    first = F.pmod(seeded(F.lit("cell"), F.col("_key"), F.col("_cell")), F.greatest(F.lit(1), F.ceil(F.col("_cell_size") / F.lit(block_words)).cast("long")))
    cells = cells.select("_key", "_cell", "_cell_size", "_quota", (first * block_words).alias("_first"))

    stream = Window.partitionBy("_key", "_cell").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    df = dealt.drop("_blocks", "_cells").join(cells, ["_key", "_cell"]).withColumn("_p", F.coalesce(F.sum("size").over(stream), F.lit(0)))
    c, p, end = F.col("_cell_size"), F.col("_p"), F.col("_p") + F.col("size")
    take = F.least(F.col("_quota") * block_words, c * repeats)
    rounds = F.floor(take / F.greatest(F.lit(1), c)).cast("long")
    df = df.withColumn("_rounds", rounds).withColumn("_until", F.col("_first") + take - rounds * c)
    overlap = F.greatest(F.lit(0), F.least(end, F.col("_until")) - F.greatest(p, F.col("_first")))
    wrapped = F.greatest(F.lit(0), F.least(end, F.col("_until") - c) - p)
    taken = (F.col("_rounds") * F.col("size") + overlap + wrapped).cast("long")
    return df.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as whole documents: each row as often as its taken words round to.

    Columns and texts stay as they are; rows with no words are never taken. Rows
    that agree in id, source and size share their number of copies.
    """
    taken = mix(docs, **options).groupBy("doc_id", "source", "size").agg(F.max("taken").alias("taken"))
    copies = taken.select(F.struct("doc_id", "source", "size").alias("_row"), F.round(F.col("taken") / F.greatest(F.lit(1), "size")).cast("int").alias("_copies")).filter("_copies > 0")
    whole = docs.select(F.struct("*").alias("_doc"), F.struct("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size")).alias("_row"))
    taken_docs = whole.join(copies, whole["_row"].eqNullSafe(copies["_row"])).select("_doc", F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("_copy"))
    return taken_docs.select(*[F.col("_doc").getField(c).alias(c) for c in docs.columns])


#: The same mix in DuckDB.
ORACLE = r"""
WITH RECURSIVE z AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'n' || md5(coalesce(text, ''))) AS name, source, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS k,
       CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT k, source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY ALL),
s1 AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER o AS ord, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS total,
       coalesce(sum(CAST(source_size AS DOUBLE) * 2) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
       sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
       FROM s1 WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
s3 AS (SELECT *, (total - capped) / rest AS level FROM s2),
s4 AS (SELECT k, source_size, least(source_size * 2.0::DOUBLE, (SELECT arg_min(level, ord) FROM s3 WHERE level * weight <= source_size * 2.0::DOUBLE) * weight) AS target FROM s3),
s5 AS (SELECT *, CAST(round(sum(target) OVER () / 16) AS BIGINT) AS seats FROM s4),
s6 AS (SELECT *, greatest(0, CAST(floor(target * (seats - (SELECT count(*) FROM s5 WHERE target > 0) / 2.0::DOUBLE) / (SELECT sum(target) FROM s5)) AS BIGINT) - 2) AS low FROM s5),
s7 AS (SELECT k, low, target, seats - (SELECT CAST(sum(low) AS BIGINT) FROM s6) AS rest, unnest(range(low, low + 60)) AS i FROM s6 WHERE target > 0),
s8 AS (SELECT k, count(*) AS won FROM (SELECT *, row_number() OVER (ORDER BY target / (2 * i + 1) DESC, k, i) AS r FROM s7) WHERE r <= rest GROUP BY k),
src AS (SELECT s6.k, source_size, target, low + coalesce(won, 0) AS blocks, greatest(1, CAST(ceil(source_size / 1000000.0::DOUBLE) AS BIGINT)) AS cells FROM s6 LEFT JOIN s8 USING (k)),
d AS (SELECT z.*, src.source_size, target, blocks, CAST('0x' || substr(md5('mix-1|' || name || '|' || k), 1, 15) AS BIGINT) AS h, cells FROM z JOIN src USING (k)),
d1 AS (SELECT *, h % cells AS cell FROM d),
c0 AS (SELECT k, cell, CAST(sum(size) AS BIGINT) AS c, any_value(blocks) AS blocks FROM d1 GROUP BY ALL),
c1 AS (SELECT *, greatest(0, CAST(floor(c * (blocks - (count(*) FILTER (WHERE c > 0) OVER w) / 2.0::DOUBLE) / greatest(1, sum(c) OVER w)) AS BIGINT) - 2) AS low FROM c0 WINDOW w AS (PARTITION BY k)),
c2 AS (SELECT k, cell, c, blocks - CAST(sum(low) OVER (PARTITION BY k) AS BIGINT) AS rest, low FROM c1),
c3 AS (SELECT k, cell, count(*) AS won FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY c / (2.0::DOUBLE * i + 1) DESC, cell, i) AS r
       FROM (SELECT *, unnest(range(low, low + 60)) AS i FROM c2 WHERE c > 0)) WHERE r <= rest GROUP BY ALL),
cl AS (SELECT c2.k, c2.cell, c, low + coalesce(won, 0) AS quota,
       16 * (CAST('0x' || substr(md5('mix-1|cell|' || c2.k || '|' || c2.cell), 1, 15) AS BIGINT) % greatest(1, CAST(ceil(c / 16.0::DOUBLE) AS BIGINT))) AS first FROM c2 LEFT JOIN c3 USING (k, cell)),
p AS (SELECT d1.doc_id, size, source_size, target, c, first, least(quota * 16, c * 2) AS take,
       CAST(coalesce(sum(size) OVER (PARTITION BY d1.k, d1.cell ORDER BY h, d1.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS p
       FROM d1 JOIN cl USING (k, cell)),
q AS (SELECT *, take // greatest(1, c) AS rounds, first + take - (take // greatest(1, c)) * c AS until FROM p)
SELECT doc_id, size, source_size, target,
       CAST(rounds * size + greatest(0, least(p + size, until) - greatest(p, first)) + greatest(0, least(p + size, until - c) - p) AS BIGINT) AS taken FROM q
"""
