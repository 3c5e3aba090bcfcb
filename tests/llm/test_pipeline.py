"""The pipeline: each stage on awkward rows, and the whole on the smallest tables."""

import random

import corpus_pipeline
from helpers import awkward, sentences

SF = "/root/testdata/sf0.001"


def test_stages_take_awkward_rows_and_empty_tables(spark):
    rng = random.Random(6)
    texts = ["\n".join(sentences(rng, 6)) for _ in range(12)]
    df = awkward(spark, texts + texts[:4] + [f"{t} more" for t in texts[4:6]])
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, SF)
        assert out.columns[: len(df.columns)] == df.columns, name
        assert out.count() > 0 and stage(spark, df.where("false"), SF).count() == 0, name
        if name != "mix":
            assert out.columns == df.columns


def test_run_equals_the_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), stage(spark, docs, SF).schema)
        counts.append(docs.count())
    got = corpus_pipeline.run(spark, SF)
    key = lambda df: sorted(map(tuple, df.select("doc_id", "copy", "text").collect()), key=repr)
    assert key(got) == key(docs)
    assert counts[4] <= counts[3] < counts[2] <= counts[1] <= counts[0]
