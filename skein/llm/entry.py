"""Queries of the training-data operators and their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard, langid, linededup, mixing, pii, sharding, tokencount
from .common import table


def op1_decontaminate(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.digest(decontaminate.find_contamination(docs, items))


def op2_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op3_pii(spark, sf_dir):
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op3_base(spark, sf_dir):
    """The columns of ``op3_pii`` that SQL can check."""
    return op3_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip", "n_card", "n_phone")


def op4_sharding(spark, sf_dir):
    return sharding.place(table(spark, sf_dir, "documents").select("doc_id"))


def op4_slots(spark, sf_dir):
    """The columns of ``op4_sharding`` that SQL can check."""
    return op4_sharding(spark, sf_dir).select("doc_id", "slot")


def op5_linededup(spark, sf_dir):
    return linededup.digest(linededup.drop_templates(table(spark, sf_dir, "documents")))


def op6_langid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op7_jaccard(spark, sf_dir):
    return jaccard.groups(table(spark, sf_dir, "documents"))


def op7_links(spark, sf_dir):
    return jaccard.links(table(spark, sf_dir, "documents"))


def op8_tokencount(spark, sf_dir):
    import public_tokenizers

    return tokencount.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op9_ann(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"))


def op9_exact(spark, sf_dir):
    """The same search when every leaf is visited: what SQL can check."""
    found = ann.search(table(spark, sf_dir, "embeddings"), recall=1.0)
    return found.select("query_id", "rank", "vec_id", F.round("score", 9).alias("score"))


def op10_chat(spark, sf_dir):
    return chat.digest(chat.records(table(spark, sf_dir, "conversations")))


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_mixing": op2_mixing,
    "op3_pii": op3_pii,
    "op3_base": op3_base,
    "op4_sharding": op4_sharding,
    "op4_slots": op4_slots,
    "op5_linededup": op5_linededup,
    "op6_langid": op6_langid,
    "op7_jaccard": op7_jaccard,
    "op7_links": op7_links,
    "op8_tokencount": op8_tokencount,
    "op9_ann": op9_ann,
    "op9_exact": op9_exact,
    "op10_chat": op10_chat,
}

ORACLES = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_base": pii.BASE_ORACLE,
    "op4_slots": sharding.SLOTS_ORACLE,
    "op5_linededup": linededup.ORACLE,
    "op7_jaccard": jaccard.ORACLE,
    "op7_links": jaccard.LINKS_ORACLE,
    "op9_exact": ann.EXACT_ORACLE,
    "op10_chat": chat.ORACLE,
}
