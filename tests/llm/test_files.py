"""Intermediate tables of few rows are few files, however many tasks the session has."""

from pathlib import Path

import pytest

from proseline.llm import mixing, packing, simhash, suffix

TASKS = 40


@pytest.fixture
def many_tasks(spark):
    conf = {"spark.sql.shuffle.partitions": str(TASKS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def written(spark):
    return sum(x.name.startswith("part-") for x in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*"))


@pytest.mark.parametrize(
    ("query", "rows"),
    [(suffix.repeated, 20), (suffix.remove_repeated, 60), (mixing.mix, 60), (packing.pack, 60)],
)
def test_few_rows_of_many_tasks_become_few_files(many_tasks, query, rows):
    text = lambda i: " ".join(f"w{i}x{k}" for k in range(90))
    passage = " ".join(f"p{k}" for k in range(55))
    texts = [(i, f"{text(i)} {passage}" if i < 20 else text(i), "ab"[i % 2]) for i in range(60)]
    docs = many_tasks.createDataFrame(texts, "doc_id long, text string, source string").repartition(TASKS)
    before = written(many_tasks)
    found = query(docs)
    assert written(many_tasks) - before < TASKS
    assert found.count() == rows


def test_documents_that_share_a_passage_meet_in_few_files(many_tasks):
    passage = " ".join(f"p{k}" for k in range(80))
    texts = [(i, f"{passage} " + " ".join(f"w{i}x{k}" for k in range(15))) for i in range(30)]
    docs = many_tasks.createDataFrame(texts, "doc_id long, text string").repartition(TASKS)
    before = written(many_tasks)
    found = simhash.keep_first(docs)
    assert written(many_tasks) - before < TASKS
    assert 0 in {r.doc_id for r in found.collect()}
