"""The registered queries and the pipeline over the smallest tables."""

import zlib
from pathlib import Path

import pytest

import corpus_pipeline
from caseloom.llm import decontaminate, simhash
from caseloom.llm.queries import QUERIES, SQL
from caseloom.llm.tables import keep
from catalog.check import compare, connect

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, name):
    assert compare(QUERIES[name](spark, FOLDER), connect(FOLDER), SQL[name]) is None


@pytest.mark.parametrize("number", range(1, 11))
def test_one_query_per_operator(number):
    assert sum(name.startswith(f"op{number}_") for name in QUERIES) == 1


def test_stages_over_tables(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    seen = [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(keep(stage(spark, seen[-1], FOLDER), f"test-{name}"))
    told, single, clean, mixed, shards = seen[1:]
    for df in (told, single, clean, mixed):
        assert df.columns == docs.columns
    groups = {r.doc_id: r.component_id for r in simhash.near_duplicates(told).collect()}
    assert sorted(r.doc_id for r in single.collect()) == sorted(set(groups.values()))
    leaked = {r.doc_id for r in decontaminate.contaminated(single, spark.read.parquet(f"{FOLDER}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - leaked
    assert shards.count() == mixed.count()
    ours = sorted((r.doc_id, r.shard) for r in corpus_pipeline.run(spark, FOLDER).collect())
    assert ours == sorted((r.doc_id, r.shard) for r in shards.collect())


def test_stages_messy(spark, messy, nothing):
    for docs in (messy, nothing):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = keep(stage(spark, docs, FOLDER), "test-messy")
            assert docs.columns == messy.columns
        shards = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
        assert shards.count() == docs.count()


def test_stages_decide_on_rows(spark):
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").filter("length(text) > 60").first()["text"]
    texts = [" ".join(f"{word}{i}" for i in range(80)) for word in ("ape", "bee", "cat", "dog")]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[1]), (None, texts[2]), (None, texts[2]), (3, texts[0]), (None, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()
    assert sorted((r.text, r.doc_id or 0) for r in left) == [(texts[0], 1), (texts[1], 1), (texts[2], 0), (texts[3], 0)]
    docs = spark.createDataFrame([(1, texts[0]), (1, item), (None, item), (None, texts[1])], "doc_id long, text string")
    left = corpus_pipeline.decontamination_stage(spark, docs, FOLDER).collect()
    assert sorted((r.text, r.doc_id or 0) for r in left) == [(texts[0], 1), (texts[1], 0)]


def test_language_stage_learns_from_all(spark):
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2][:30]
    free = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][:30]
    rows = [(i, "zut qwx vrr kzz yyx jqq wvv", "xx") for i in held] + [(i, "the cat and the dog ran home", "en") for i in free]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    seen = []
    train = corpus_pipeline.language.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(corpus_pipeline.language, "train", lambda rows: seen.append(rows) or train(rows))
        assert corpus_pipeline.language_stage(spark, docs, FOLDER).count() == 60
    assert seen[0].count() == 60


def test_stages_keep_any_columns(spark):
    texts = [" ".join(f"{word}{i}" for i in range(80)) for word in ("ape", "bee", "cat")]
    rows = [(1, texts[0], None, "web", "k1", {"a": 1}, 5), (2, texts[1], "web", None, "k2", {}, 6), (2, texts[2], None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _key string, doc map<string,int>, row long")
    for stage in (corpus_pipeline.near_duplicate_stage, corpus_pipeline.decontamination_stage):
        left = stage(spark, docs, FOLDER)
        assert left.columns == docs.columns
        assert sorted(map(str, left.collect())) == sorted(map(str, docs.collect()))


def test_near_duplicates_tell_nulls_apart(spark):
    text = " ".join(f"ape{i}" for i in range(80))
    rows = [(None, text, "web", None), (None, text, None, "web"), (7, text, None, None), (7, text, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    left = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER).collect()
    assert [tuple(r) for r in left] == [(7, text, None, None)]
    left = corpus_pipeline.decontamination_stage(spark, docs, FOLDER).collect()
    assert sorted(map(str, left)) == sorted(map(str, docs.collect()))


def test_rows_that_stay_are_found_by_shuffle_at_every_size(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    stayed = corpus_pipeline.near_duplicate_stage(spark, docs, FOLDER)
    plan = stayed._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [row" in plan and "BroadcastHashJoin" not in plan


def test_tables_of_earlier_stages_are_removed(spark, monkeypatch):
    gone = []
    monkeypatch.setattr(corpus_pipeline, "release", lambda *tables: gone.extend(t._scratch for t in tables))
    assert corpus_pipeline.run(spark, FOLDER).count() > 0
    assert [name for path in gone for name, _ in corpus_pipeline.STAGES if f"/pipeline-{name}-" in path] == [
        "language", "near_duplicates", "decontamination"
    ]
