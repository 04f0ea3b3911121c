"""The stages of the pipeline against brute force, and the whole of it over the smallest supplied tables."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cladeworks.llm import decontaminate, line_dedup, mixing, near_join

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no supplied tables")


def test_pipeline(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality = 1").collect()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(spark, docs, DATA).cache()
        after = [(r.doc_id, r.text) for r in docs.collect()]
        assert docs.columns == columns + (["mix_block", "mix_slot", "mix_position"] if name == "mixture" else []), name
        if name == "quality":
            kept = {d for d, _ in after}
            assert len(kept & bad) <= 0.2 * max(1, len(bad)) and len(good - kept) <= 0.05 * len(good)
        elif name == "repeated_lines":
            want = dict(zip(before, line_dedup.brute(list(before.items()), 50), strict=True))
            assert dict(after) == {d: t for d, t in want.items() if t == before[d] or t.strip()}
        elif name == "near_copies":
            assert {d for d, _ in after} == {d for d, x in near_join.brute(before, 5, 80, 100).items() if x[1] == d}
        elif name == "benchmark_leaks":
            assert {d for d, _ in after} == {d for d, t in before.items() if not decontaminate.brute(t, items)[1]}
        else:
            assert dict(after) == before and len(after) == len(before)


def test_run_returns_places_in_the_mixture(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-1:])
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {}
    for r in docs.select("doc_id", "source").collect():
        ids.setdefault((r.source is None, r.source or ""), []).append(r.doc_id)
    names = sorted(ids)
    got = corpus_pipeline.run(spark, DATA)
    assert got.columns == [*docs.columns, "mix_block", "mix_slot", "mix_position"]
    rows = got.orderBy("mix_position").collect()
    want, left = [], {n: sorted(x) for n, x in ids.items()}
    for s, i in mixing.brute([int(len(ids[n]) ** 0.5 * 1000000) for n in names], [-(-len(ids[n]) // 16) for n in names]):
        block, left[names[i]] = left[names[i]][:16], left[names[i]][16:]
        want += [(d, s, s * 16 + k) for k, d in enumerate(block)]
    assert [(r.doc_id, r.mix_slot, r.mix_position) for r in rows] == want
    clash = mixing.places(docs.withColumn("Mix_Slot", docs.n_chars))
    assert clash.columns[-3:] == ["_mix_block", "_mix_slot", "_mix_position"] and clash.count() == len(rows)


@pytest.mark.parametrize("rows", ["none", "odd"])
def test_stages_with_nulls_repeats_and_clashing_columns(spark, rows):
    text = "one two three four five six seven eight nine ten\n" * 3
    own = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "en", "a", 0), (None, text, None, "b", 7), (None, None, None, None, None), (4, text + "x", "de", "b", None), (5, "word " * 30_000, "en", "c", 9)]
    docs = spark.createDataFrame(own, "doc_id long, text string, lang string, source string, n_chars long")
    if rows == "none":
        docs = docs.limit(0)
    for i, name in enumerate(("_score", "_lines", "_leaks", "_mix", "a.b", "c0", "r", "d", "t", "mix_slot")):
        docs = docs.withColumn(name, F.lit(i))
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, DATA)
        assert after.columns[: len(docs.columns)] == docs.columns, name
        kept = after.collect()
        if rows == "none":
            assert not kept
        elif name == "repeated_lines":
            assert sum(r.doc_id == 5 for r in kept) == 1 and sum(r.doc_id is None for r in kept) == 2
        elif name == "near_copies":
            assert sorted(str(r.doc_id) for r in kept) == ["1", "1", "2", "3", "5", "None", "None"]
        elif name in ("benchmark_leaks", "mixture"):
            assert len(kept) == len(own)


def test_registered():
    import __spark_entry__ as driver

    names = list(driver.queries())
    assert [n for n in names if n.startswith("op")] and "pipeline" in names
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 11))
    assert set(driver.oracle_sql()) <= set(names)
