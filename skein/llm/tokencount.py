"""Token counts through a digest cache.

Content digests are joined with the stored counts of the tokenizer version (the
digest of its file); only distinct misses are encoded, and their counts are
appended to the cache, a Parquet table in a shared folder. Normalised content is
the text itself, null as empty: any other normalisation could change counts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import Sent, by_key, cut, scratch

LIMIT = 4096
CACHE = "digest binary, version string, n_tokens bigint"
#: Longer texts are encoded in parts of about so many characters, where that is exact.
_PART = 1 << 19


class Tokenizer:
    """A tokenizer shipped to executors by value: file bytes and kind."""

    def __init__(self, path: str) -> None:
        self.data, self.kind = Path(path).read_bytes(), path.rpartition(".")[2]
        if self.kind not in ("model", "json"):
            raise ValueError("a sentencepiece .model or a tokenizers .json file is needed")
        self.version = hashlib.sha256(self.kind.encode() + b"\0" + self.data).hexdigest()

    def counter(self):
        """A function from a list of texts to their numbers of tokens."""
        if self.kind == "json":
            from tokenizers import Tokenizer as Fast

            fast = Fast.from_str(self.data.decode())
            fast.no_truncation()
            fast.no_padding()
            return lambda texts: [len(x.ids) for x in fast.encode_batch(texts, add_special_tokens=False)]
        import sentencepiece

        piece = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        names = [piece.id_to_piece(i) for i in range(piece.get_piece_size())]
        # A blank opens a piece and never stands inside one, and the text gets a
        # blank in front: a text may be cut at a lone blank, which the next part
        # gets back as its own first blank.
        splits = not any("▁" in n.lstrip("▁") for n in names) and piece.encode("a b", out_type=str)[0][0] == "▁"

        def count(texts: list[str]) -> list[int]:
            parts, owner = [], []
            for k, text in enumerate(texts):
                for part in _parts(text) if splits and len(text) > _PART else [text]:
                    parts.append(part)
                    owner.append(k)
            out = [0] * len(texts)
            for k, ids in zip(owner, piece.encode(parts, num_threads=1)):
                out[k] += len(ids)
            return out

        return count


def _parts(text: str) -> Iterator[str]:
    low = 0
    while len(text) - low > _PART:
        at = text.find(" ", low + _PART)
        while at > 0 and (text[at - 1] == " " or text[at + 1 : at + 2] in (" ", "", "▁") or text[at - 1] == "▁"):
            at = text.find(" ", at + 1)
        if at < 0:
            break
        yield text[low:at]
        low = at + 1
    yield text[low:]


def _encoder(tokenizer):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = None
        for batch in batches:
            count = count or tokenizer.value.counter()
            for low in range(0, batch.num_rows, 64):
                part = batch.slice(low, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(count([t or "" for t in part.column(1).to_pylist()]), pa.int64())], ["digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str, cache: str | None = None, *, limit: int = LIMIT) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``n_tokens`` and ``over_limit`` of each row.

    ``cache`` is the cache's path in a shared folder (created when missing); by
    default a new one. Null text counts as empty, with no tokens; equal texts are
    encoded once, whatever their number; repeated cache entries are harmless; an
    empty table gives no rows. Begin, end and other special tokens are never
    added, texts are never cut. Other columns are ignored.
    """
    spark = docs.sparkSession
    cache = cache or scratch(spark, "token-counts")
    tokenizer = Tokenizer(tokenizer_path)
    spark.createDataFrame([], CACHE).coalesce(1).write.mode("append").parquet(cache)  # it exists from here on
    text = F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.sha2(text, 256)).alias("digest")
    keyed = cut(docs.select("doc_id", digest, F.octet_length(text).cast("long").alias("n_bytes")))
    known = spark.read.parquet(cache).filter(F.col("version") == tokenizer.version)
    contents = cut(keyed.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("rows")))
    missing = contents.join(known.select("digest"), "digest", "left_anti")
    texts = docs.select("doc_id", digest, text.alias("text"))
    wanted = texts.join(missing, (texts["digest"] == missing["digest"]) & texts["doc_id"].eqNullSafe(missing["doc_id"]), "left_semi").select("digest", "text")
    sent = Sent(spark, tokenizer)
    counted = wanted.mapInArrow(_encoder(sent), "digest binary, n_tokens bigint")
    counted.select("digest", F.lit(tokenizer.version).alias("version"), "n_tokens").write.mode("append").parquet(cache)
    known = spark.read.parquet(cache).filter(F.col("version") == tokenizer.version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    # A text of many copies would be one key of a shuffled join.
    counts = cut(contents.select("digest", "rows").join(known, "digest"))
    total = contents.agg(F.sum("rows")).first()[0] or 0
    return by_key(keyed, counts, "digest", "rows", total).select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
