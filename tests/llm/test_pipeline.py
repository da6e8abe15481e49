"""The pipeline, stage by stage, against brute force on what each stage is given."""

import pytest
from pyspark.sql import functions as F
from test_operators import as_rows, brute_hits, brute_near

import corpus_pipeline
from latticework.llm import mixing, pii, toxicity


@pytest.fixture(scope="module")
def steps(spark, smoke, tmp_path_factory):
    """The tables before and after each stage."""
    docs = spark.read.parquet(f"{smoke}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, found[-1], smoke).write.parquet(path)
        found.append(spark.read.parquet(path))
    return found


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_names_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "pii", "mixing"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_toxic_documents_go(spark, steps, smoke):
    scored = toxicity.scores(steps[0], spark.read.parquet(f"{smoke}/labels.parquet"))
    assert ids(steps[1]) == ids(scored.filter("predicted = 0"))


def test_one_of_each_group_stays(steps):
    assert ids(steps[2]) == sorted(d for d, _, _, k in brute_near(as_rows(steps[1]), 5) if k)


def test_contaminated_documents_go(spark, steps, smoke):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{smoke}/benchmark.parquet").collect()]
    judged = brute_hits(as_rows(steps[2]), items)
    assert ids(steps[3]) == sorted(r[0] for r in judged if not r[-1])
    clean = {r[0] for r in judged if not r[2]}
    before, after = dict(as_rows(steps[2])), dict(as_rows(steps[3]))
    assert all(after[d] == before[d] for d in clean)
    assert all(r[2] == 0 for r in brute_hits(as_rows(steps[3]), items) if r[0] in clean)


def test_surrogates_change_only_texts_with_entities(steps):
    assert ids(steps[4]) == ids(steps[3])
    before, after = dict(as_rows(steps[3])), dict(as_rows(steps[4]))
    changed = {r.doc_id for r in pii.replace(steps[3]).filter("changed").collect()}
    assert {d for d in before if before[d] != after[d]} <= changed


def test_mix_takes_what_the_queue_says(steps):
    wanted = {r.doc_id: r.n for r in mixing.queued(steps[4]).filter("taken > 0").select("doc_id", F.expr("taken div size").alias("n")).collect()}
    assert {r.doc_id: r["count"] for r in steps[5].groupBy("doc_id").count().collect()} == wanted


def test_run_gives_the_last_stage(spark, smoke, steps):
    assert ids(corpus_pipeline.run(spark, smoke)) == ids(steps[5])
