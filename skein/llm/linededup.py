"""Line dedup by a log-template tree (DataFrame functions only).

Every line that is not blank is looked at. Its tokens are its blank-separated
parts; tokens that look like a field with a digit are variable at once (``<*>``):
at most 63 characters before the first digit and 64 after it, so that a passage
without blanks is never taken for a field. The tree has fixed depth: token count,
then the first ``depth`` tokens; a leaf holds all lines that agree in these. In a
leaf, a token that stands at the same position in at least ``min_docs`` documents
is a constant, every other one is generalised to ``<*>``. What remains is the
line's template. A template that recurs in at least ``min_docs`` documents is
boilerplate, and its lines are dropped from every document: those whose masked
form recurs by itself, whatever its share of constants, and where different lines
make a template those whose tokens are constants to at least ``min_constant``.
Everywhere, documents are counted, not their lines: many lines of one document
count once.

Counts are pre-aggregated by hash before each shuffle, and lines of leaves too
rare to hold a recurring template never reach the token step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .common import bounded, cut

DEPTH = 3
MIN_DOCS = 5
MIN_CONSTANT = 0.7
VARIABLE = "<*>"

#: A field with a digit, begun only where a token begins and ended where it ends.
_BLANK, _DIGIT = r"[ \t\r\f\x0b]", r"(?<![^ \t\r\f\x0b\n])[^ \t\r\f\x0b\n0-9]{0,63}+[0-9][^ \t\r\f\x0b\n]{0,64}+(?![^ \t\r\f\x0b\n])"


def masked_lines(text: Column) -> Column:
    """Lines with single blanks between tokens and variable tokens masked.

    Texts that hold nothing to squeeze or mask skip the patterns.
    """
    untidy = [F.contains(text, F.lit(x)) for x in ("  ", "\n ", " \n", "\t", "\r", "\f", "\x0b")]
    untidy += [F.startswith(text, F.lit(" ")), F.endswith(text, F.lit(" "))]
    squeezed = F.regexp_replace(F.regexp_replace(text, _BLANK + "+", " "), "(?dm)^ | $", "")
    tidy = F.when(reduce(Column.__or__, untidy), squeezed).otherwise(text)
    return F.split(F.when(F.rlike(text, F.lit("[0-9]")), F.regexp_replace(tidy, _DIGIT, VARIABLE)).otherwise(tidy), "\n")


def _n_tokens(line: Column) -> Column:
    return F.when(line == "", 0).otherwise(F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit(""))) + 1)


def _with_leaf(lines: DataFrame, depth: int) -> DataFrame:
    lines = lines.withColumn("_n", _n_tokens(F.col("_line")))
    return lines.withColumn("_leaf", F.xxhash64("_n", F.substring_index("_line", " ", depth)))


def placed_lines(docs: DataFrame, *, depth: int = DEPTH) -> DataFrame:
    """Where each line stands: (doc_id, row number, text hash, position, leaf, line hash);
    to be stored before use, as rows are numbered anew each time."""
    # Rows that repeat an id and text are documents of their own.
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("_row"))
    lines = rows.select("doc_id", "_row", F.xxhash64("text").alias("_t"), F.posexplode(masked_lines(F.col("text"))).alias("_pos", "_line"))
    lines = _with_leaf(lines, depth).filter("_n > 0")
    return lines.select("doc_id", "_row", "_t", "_pos", "_leaf", F.xxhash64("_line").alias("_h"))


def templates(docs: DataFrame, placed: DataFrame, *, depth: int = DEPTH, min_docs: int = MIN_DOCS, min_constant: float = MIN_CONSTANT) -> DataFrame:
    """Masked lines (``_line``) whose template recurs, with ``template`` and ``n_docs``."""
    # A leaf of fewer lines cannot hold a template of so many documents.
    leaves = cut(placed.groupBy("_leaf").agg(F.count("*").alias("_c")).filter(F.col("_c") >= min_docs).select("_leaf"))
    # Distinct lines of a document, so that counts are of documents.
    each = _with_leaf(docs.select(F.explode(F.array_distinct(masked_lines(F.col("text")))).alias("_line")), depth).filter("_n > 0")
    lines = cut(each.join(bounded(leaves), "_leaf", "left_semi").groupBy("_leaf", "_n", "_line").agg(F.count("*").alias("_docs")))
    tokens = lines.select("_leaf", F.xxhash64("_line").alias("_id"), "_docs", F.posexplode(F.split("_line", " ")).alias("_pos", "_token"))
    place = ["_leaf", "_pos", "_token"]
    # The sum over a token's lines is the most documents it can have, the largest of them the least.
    often = tokens.filter(F.col("_token") != VARIABLE).groupBy(place).agg(F.sum("_docs").alias("_most"), F.max("_docs").alias("_least"))
    often = cut(often.filter(F.col("_most") >= min_docs))
    doubtful = cut(tokens.join(often.filter(F.col("_least") < min_docs), place, "left_semi").select(*place, F.col("_id").alias("_h")))
    held = placed.join(bounded(cut(doubtful.select("_h").distinct())), "_h", "left_semi").select("_h", "_row").distinct()
    settled = doubtful.join(held, "_h").select(*place, "_row").distinct().groupBy(place).count().filter(F.col("count") >= min_docs)
    constants = often.filter(F.col("_least") >= min_docs).select(place).unionByName(settled.select(place))
    # The lines of a leaf share their first tokens: large keys, which adaptive execution splits.
    kept = tokens.join(constants, place, "left_semi")
    shape = kept.groupBy("_leaf", "_id").agg(F.array_sort(F.collect_list(F.struct("_pos", "_token"))).alias("_kept"))  # at most a line's tokens
    shaped = lines.withColumn("_id", F.xxhash64("_line")).join(shape, ["_leaf", "_id"], "left")
    shaped = shaped.withColumn("_kept", F.coalesce("_kept", F.array().cast(shape.schema["_kept"].dataType)))
    # All tokens of a line that recurs are constants or variable: it is its own template.
    fixed = F.size("_kept") >= F.col("_n") * min_constant
    shaped = shaped.filter(fixed | (F.col("_docs") >= min_docs))
    known = F.map_from_entries("_kept")
    template = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.try_element_at(known, i), F.lit(VARIABLE))), " ")
    shaped = cut(shaped.select("_line", "_docs", template.alias("template")))
    likely = shaped.groupBy("template").agg(F.sum("_docs").alias("_most")).filter(F.col("_most") >= min_docs).select("template")
    shaped = cut(shaped.join(likely, "template", "left_semi").select("_line", "template", F.xxhash64("_line").alias("_h"), F.xxhash64("template").alias("_t")))
    # Each document once a template, however many of its lines it holds.
    held = placed.select("_h", "_row").join(bounded(shaped.select("_h", "_t")), "_h").select("_t", "_row").distinct()
    recurring = held.groupBy("_t").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") >= min_docs)
    return shaped.join(recurring, "_t").select("_line", "template", "n_docs")


def drop_templates(docs: DataFrame, *, depth: int = DEPTH, **options) -> DataFrame:
    """Documents without lines of recurring templates.

    Returns ``docs`` with ``text`` rewritten (kept lines, joined by line feeds)
    and ``n_lines`` and ``n_dropped`` added or replaced. Blank lines always stay;
    null text has no lines and stays null; repeated rows count as documents of
    their own and are treated alike; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    placed = cut(placed_lines(docs, depth=depth))
    dropped = cut(templates(docs, placed, depth=depth, **options).select(F.xxhash64("_line").alias("_h")).distinct())
    gone = placed.join(bounded(dropped), "_h", "left_semi").groupBy("doc_id", "_t").agg(F.collect_set("_pos").alias("_gone"))  # at most a document's lines
    gone = gone.select(F.struct("doc_id", "_t").alias("_key"), "_gone")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in others]).alias("_doc"), F.struct("doc_id", F.xxhash64("text").alias("_t")).alias("_key"))
    both = whole.join(gone, whole["_key"].eqNullSafe(gone["_key"]), "left").select("_doc", F.coalesce("_gone", F.array().cast("array<int>")).alias("_gone"))
    text = F.col("_doc").getField("text")
    kept = F.when(F.size("_gone") == 0, text).otherwise(F.array_join(F.filter(F.split(text, "\n"), lambda x, i: ~F.array_contains("_gone", i)), "\n"))
    return both.select(
        *[(kept if c == "text" else F.col("_doc").getField(c)).alias(c) for c in others],
        F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long").alias("n_lines"),
        F.size("_gone").cast("long").alias("n_dropped"),
    )


def digest(cleaned: DataFrame) -> DataFrame:
    """The result columns of the registered query."""
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: The same templates in DuckDB, line by line and token by token.
ORACLE = r"""
WITH m AS (SELECT doc_id, text, row_number() OVER () AS rid, string_split(text, chr(10)) AS raw FROM documents),
p AS (SELECT rid, unnest(raw) AS line, unnest(range(len(raw))) AS pos FROM m),
q AS (SELECT rid, pos, [CASE WHEN regexp_matches(x, '^[^0-9]{0,63}[0-9].{0,64}$') THEN '<*>' ELSE x END FOR x IN regexp_split_to_array(line, '[ \t\r\f\x0b]+') IF x <> ''] AS tok FROM p),
f AS (SELECT DISTINCT rid, tok, len(tok) AS n, array_to_string(tok[1:3], ' ') AS head FROM q WHERE len(tok) > 0),
l AS (SELECT n, head, tok, count(*) AS docs FROM f GROUP BY ALL),
c AS (SELECT n, head, i, tok[i] AS token FROM (SELECT rid, n, head, tok, unnest(range(1, n + 1)) AS i FROM f) WHERE tok[i] <> '<*>' GROUP BY ALL HAVING count(DISTINCT rid) >= 5),
t AS (SELECT n, head, tok, docs, unnest(range(1, n + 1)) AS i FROM l),
s AS (SELECT t.n, t.head, tok, any_value(docs) AS docs, string_agg(coalesce(c.token, '<*>'), ' ' ORDER BY t.i) AS template, count(c.token) AS kept
      FROM t LEFT JOIN c ON t.n = c.n AND t.head = c.head AND t.i = c.i AND t.tok[t.i] = c.token GROUP BY t.n, t.head, tok),
k AS (SELECT tok, template FROM s WHERE kept >= n * 0.7::DOUBLE OR docs >= 5),
r AS (SELECT template FROM k JOIN f USING (tok) GROUP BY template HAVING count(DISTINCT rid) >= 5),
x AS (SELECT rid, list(pos) AS gone FROM q JOIN (SELECT DISTINCT tok FROM k JOIN r USING (template)) g USING (tok) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_dropped,
       sha256(coalesce(array_to_string([raw[i] FOR i IN range(1, len(raw) + 1) IF NOT list_contains(coalesce(gone, []), i - 1)], chr(10)), '')) AS kept_sha256
FROM m LEFT JOIN x USING (rid)
"""
