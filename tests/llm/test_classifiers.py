"""Language and quality classifiers: held-out accuracy and defined results for awkward rows."""

import numpy as np
from helpers import awkward

from plotweave.llm import language, quality

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    got = language.language_id(df).join(df.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 1500 and (got.lang_pred == got.lang).mean() > 0.98
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_language_of_awkward_rows(spark):
    df = awkward(spark, ["The and of the thing", "12 34", "...", None])
    rows = {r.doc_id: r for r in language.language_id(df).collect()}
    assert len(rows) == df.select("doc_id").distinct().count()
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 8, 101, 102, 103))
    assert rows[9].lang_pred in ("en", "de", "fr")
    assert language.language_id(df.where("false")).count() == 0
    kept = language.reject_unknown(df)
    assert kept.columns == df.columns and not {1, 2, 8} & {r.doc_id for r in kept.collect()}
    alone = language.language_id(df.where("lang = 'en'"))
    assert {r.lang_pred for r in alone.collect()} == {"en", "und"}


def test_pipeline_stage_keeps_clean_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert language.reject_unknown(df).count() >= 0.99 * df.count()


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        codes = language.codewords(n)
        distance = (codes.shape[1] - codes @ codes.T) / 2
        assert distance[~np.eye(n, dtype=bool)].min() >= (1 if n < 4 else codes.shape[1] // 4)


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    got = quality.quality(docs, labels).join(labels.select("doc_id", "quality"), "doc_id").where("held_out").toPandas()
    assert len(got) > 500 and (got.predicted == got.quality).mean() > 0.95
    assert (got.predicted == (got.score >= 0.7)).all()


def test_quality_of_awkward_rows(spark):
    df = awkward(spark, ["words of a text"] * 5)
    labels = spark.createDataFrame([(100, 1, 0, "x"), (101, 0, 0, "x"), (102, None, 0, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = quality.quality(df, labels).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.quality(df.where("false"), labels).count() == 0
    assert {r.score for r in quality.quality(df, labels.where("false")).collect()} == {0.5}


def test_chunks_cover_every_byte():
    for n in (0, 1, 63, 64, 65, 511, 512, 513, 959, 960, 961, 5000):
        data = (np.arange(n) % 255 + 1).astype(np.uint8)
        x, rows = quality.chunks_of(np.array([0, n]), data)
        step = quality.CHUNK - quality.OVERLAP
        seen = np.zeros(n, bool)
        for k, chunk in enumerate(x):
            part = data[k * step : k * step + quality.CHUNK]
            assert (chunk[: len(part)] == part).all() and not chunk[len(part) :].any()
            seen[k * step : k * step + quality.CHUNK] = True
        assert seen.all() and (rows == 0).all()


def test_every_language_is_learned(spark):
    letters = [chr(ord("a") + i) + chr(ord("a") + j) for i in range(26) for j in range(24)]
    rows = [(i * 4 + k, f"{x}{x} " * 30, x) for i, x in enumerate(letters) for k in range(4)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=3)
    assert model["languages"] == sorted(letters) and model["bits"][0].shape[1] == model["codes"].shape[1]
