"""Mixing sources."""

import check
from helpers import awkward

from plotweave.llm import mixing


def targets(sizes, weights, share, ceiling):
    """The rule as it is stated: share by weight, cut, share the excess anew."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, free, pot = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while pot > 1e-9 and free:
        total = sum(w[s] for s in free)
        for s in free:
            out[s] += pot * w[s] / total
        full = {s for s in free if out[s] >= ceiling * sizes[s]}
        pot = sum(out[s] - ceiling * sizes[s] for s in full)
        out.update({s: ceiling * sizes[s] for s in full})
        free -= full
    return out


def test_targets(spark):
    sizes = {"b": 1000, "a": 10, "C": 5, "é": 300, "\U0001f600": 7, None: 900, "": 0, "zz": 40}
    df = spark.createDataFrame([(s, n) for s, k in sizes.items() for n in (k // 2, k - k // 2)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets(sizes, (3, 1, 2), 1.5, 2)
    assert all(abs(got[s] - want[s]) < 1e-6 for s in want) and len(got) == len(want)


def test_taken_comes_near_its_target(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = mixing.mix_plan(df)
    assert rows.where("taken > 2 * size").count() == 0
    sums = rows.groupBy("source").agg({"taken": "sum", "target": "max", "source_size": "max"}).collect()
    for r in sums:
        assert abs(r["sum(taken)"] - r["max(target)"]) < 0.15 * r["max(source_size)"]


def test_mix_emits_what_the_plan_takes(spark):
    df = awkward(spark, ["some words of a text"] * 30)
    plan = mixing.mix_plan(df).groupBy("doc_id").sum("n_copies").collect()
    mixed = mixing.mix(df)
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {r["doc_id"]: r["sum(n_copies)"] for r in plan if r["sum(n_copies)"]}
    assert mixed.columns[: len(df.columns)] == df.columns and len(mixed.columns) == len(df.columns) + 1
    assert mixing.mix(df.where("false")).count() == 0 == mixing.mix_plan(df.where("false")).count()


def test_plan_equals_sql_on_awkward_rows(spark, tmp_path):
    awkward(spark, ["a b c", "d e", "f"] * 5).select("doc_id", "text", "source").write.parquet(str(tmp_path / "documents.parquet"))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    from plotweave.llm.queries import ORACLES, QUERIES

    df = QUERIES["op4_source_mixing"](spark, str(tmp_path))
    assert check.compare(df, con, ORACLES["op4_source_mixing"]) is None
