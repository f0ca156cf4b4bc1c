"""Learned parts on rows that they didn't learn from, and vectorised parts against plain ones."""

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from proseline.llm import chat, langid, media, quality

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@tables
def test_held_out_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = langid.identify(docs).select("doc_id", "lang_pred", "score", langid.held_out().alias("held_out"))
    joined = found.join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = joined.agg(F.count("*"), F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.98


def test_a_held_out_label_changes_no_prediction(spark):
    draw = random.Random(3)
    say = lambda letters, n: " ".join("".join(draw.choice(letters) for _ in range(5)) for _ in range(n))
    rows = [(i, say("abcde" if i % 2 else "vwxyz", 30), "en" if i % 2 else "de") for i in range(60)]
    held = {r.doc_id for r in spark.createDataFrame(rows, "doc_id long, text string, lang string").where(langid.held_out()).collect()}
    wrong = [(i, t, "fr" if i in held else lang) for i, t, lang in rows]
    a, b = ({r.doc_id: (r.lang_pred, r.score) for r in langid.identify(spark.createDataFrame(x, "doc_id long, text string, lang string")).collect()} for x in (rows, wrong))
    assert held and a == b


@tables
def test_quality_on_labels_that_were_not_used(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    used = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    judged = quality.judge(docs, labels.where(used)).join(labels.where(~used), "doc_id")
    good = judged.where("quality = 1").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good >= 0.95 and bad <= 0.1


def test_paths_equal_a_walk_down_each_tree():
    draw = np.random.default_rng(5)
    rows = draw.normal(size=(300, len(quality.FEATURES)))
    forest = quality.Forest(rows, trees=20, sample=64)

    def walk(tree, row):
        feature, split, left, right, length = tree
        at = 0
        while feature[at] >= 0:
            at = left[at] if row[feature[at]] < split[at] else right[at]
        return length[at]

    found = forest.paths(rows)
    want = [np.mean([walk(t, r) for t in forest.trees]) for r in rows]
    assert np.allclose(found, want)
    far = forest.paths(np.full((1, len(quality.FEATURES)), 50.0))[0]
    assert far < found.mean()


def test_the_sample_of_labelled_rows_is_bounded_and_seeded(spark):
    draw = random.Random(6)
    rows = [(i, " ".join(f"w{draw.randrange(500)}" for _ in range(60)) + (" ###" * 40 if i % 5 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 > 0)) for i in range(400)], "doc_id long, quality int")
    a, b = ({r.doc_id: r.path for r in quality.judge(docs.repartition(n), labels, labelled=100).collect()} for n in (2, 5))
    assert a == b
    kept = {r.doc_id for r in quality.judge(docs, labels, labelled=100).where("kept").collect()}
    assert len(kept & {i for i in range(400) if i % 5}) >= 0.95 * 320 and not kept & set(range(0, 400, 5))


def test_all_labelled_rows_set_the_threshold(spark):
    # more labelled rows than one bounded sample had; the threshold is told again from all of them
    draw = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(draw.choices(words, k=draw.randrange(24, 60))) + " ###" * int(draw.expovariate(1 if i % 10 else 0.2))) for i in range(24_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(24_000)], "doc_id long, quality int")
    found = quality.judge(docs, labels).toPandas()
    free = ~found["base_failed"].to_numpy()
    paths, good = found["path"].to_numpy()[free], found["doc_id"].to_numpy()[free] % 10 > 0
    threshold = quality.calibrate(paths, good)
    assert free.sum() > 20_000 and np.isfinite(threshold)
    assert np.array_equal(found["kept"].to_numpy()[free], paths >= threshold)


def test_ranges_of_paths_give_the_threshold_of_all_paths(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILE_ROWS", 100)
    draw = np.random.default_rng(9)
    for most_lost, decimals in ((0.002, 9), (0.05, 2), (1.0, 1)):
        good = draw.random(2000) < 0.8
        paths = np.round(draw.normal(size=2000) + good, decimals)
        scored = spark.createDataFrame(list(zip(paths.tolist(), good.tolist(), strict=True)), "path double, good boolean")
        assert quality.calibrated(scored, 2000, most_lost) == quality.calibrate(paths, good, most_lost)


def test_difference_hash_compares_neighbours():
    pixels = np.random.default_rng(2).integers(0, 256, (40, 45)).astype(np.uint8)
    means = [[int(pixels[5 * i : 5 * i + 5, 5 * j : 5 * j + 5].astype(int).sum() // 25) for j in range(9)] for i in range(8)]
    bits = "".join("1" if row[j] < row[j + 1] else "0" for row in means for j in range(8))
    assert media.difference_hash(pixels) == f"{int(bits, 2):016x}"


def test_very_long_texts(spark):
    words = " ".join(["the", "house", "which"] * 200_000)
    docs = spark.createDataFrame([(i, words if i == 0 else "der garten nicht", "en" if i % 2 == 0 else "de") for i in range(8)], "doc_id long, text string, lang string")
    assert next(r for r in langid.identify(docs).collect() if r.doc_id == 0).lang_pred in ("en", "de")
    turns = spark.createDataFrame([(1, 0, "user", words), (1, 1, "assistant", words)], "conv_id long, turn long, role string, text string")
    r = chat.read_back(chat.format_chats(turns)).first()
    assert (r.n_turns, r.loss_chars) == (2, len(words))
    judged = quality.judge(docs, spark.createDataFrame([], "doc_id long, quality int")).where("doc_id = 0").first()
    assert (judged.n_words, judged.n_repeat_words) == (600_000, 600_000)
