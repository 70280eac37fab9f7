"""Cases that a review found too large."""

from skein.llm import langid

SF = "/root/testdata/sf0.001"


def test_training_leaves_the_driver(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    expected = langid.train(langid.training_rows(docs))
    lengths = []
    plain = langid.train
    monkeypatch.setattr(langid, "train", lambda rows, **options: lengths.append(len(rows)) or plain(rows, **options))
    found = langid.fit(docs)
    assert not any(lengths)  # no texts are here
    assert found.languages == expected.languages
    assert (found.grams == expected.grams).all() and (found.words == expected.words).all() and (found.lexicon == expected.lexicon).all()
    assert langid.fit(docs.limit(0)).languages == []
