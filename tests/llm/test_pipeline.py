"""The pipeline, stage by stage, against plain versions of the same decisions."""

import hashlib
from collections import Counter

import corpus_pipeline
import pytest
from conftest import SF
from skein.llm import langid, sharding
from skein.llm.common import WordHasher
from test_llm import contamination, groups7, odd

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's input and output."""
    folder, out = tmp_path_factory.mktemp("stages"), []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        out.append((name, docs, after))
        docs = after
    return out


def test_order_and_columns(stages):
    assert [n for n, _, _ in stages] == ["language_id", "near_duplicates", "decontamination", "source_mixing", "sharding"]
    assert all(after.columns == COLUMNS for _, _, after in stages[:-1])
    assert stages[-1][2].columns == [*COLUMNS, "slot", "shard"]


def test_language_id(stages):
    _, before, after = stages[0]
    rows = before.collect()
    predicted = langid.fit(before).predict([(r.text or "").encode() for r in rows], WordHasher())
    keep = {r.doc_id for r, (lang, score, _) in zip(rows, predicted) if lang != "und" and score >= langid.MIN_SCORE}
    assert {r.doc_id for r in after.collect()} == keep


def test_near_duplicates(stages):
    _, before, after = stages[1]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    keep = {rows[i].doc_id for i, (_, c) in enumerate(groups7([r.text for r in rows])) if i == c}
    assert {r.doc_id for r in after.collect()} == keep


def test_decontamination(spark, stages):
    _, before, after = stages[2]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    keep = {r.doc_id for r in before.collect() if not contamination(r.text, items)[2]}
    assert {r.doc_id for r in after.collect()} == keep


def test_mixing(stages):
    from skein.llm import mixing

    _, before, after = stages[3]
    texts = {r.doc_id: r.text for r in before.collect()}
    copies = Counter(r.doc_id for r in after.collect())
    expected = {r.doc_id: int(r.taken / r.size + 0.5) for r in mixing.mix(before).collect() if r.size}
    assert copies == Counter({k: n for k, n in expected.items() if n}) and max(copies.values()) <= 2
    assert all(texts[r.doc_id] == r.text for r in after.collect())


def test_sharding(stages):
    _, before, after = stages[4]
    table = sharding.lookup_table([f"shard-{k:05d}" for k in range(64)])
    rows = after.collect()
    assert len(rows) == before.count()
    for r in rows:
        assert r.shard == f"shard-{table[int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SIZE]:05d}"


def test_run(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, stages[-1][2].collect()))


@pytest.mark.parametrize("k", range(5))
def test_odd_rows(spark, k):
    name, stage = corpus_pipeline.STAGES[k]
    out = stage(spark, odd(spark), SF)
    assert out.count() <= 18
    if k < 4:
        assert out.columns == odd(spark).columns
    assert stage(spark, odd(spark).limit(0), SF).count() == 0
