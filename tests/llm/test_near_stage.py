import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from proseline.llm import common, simhash


def sayer(seed, words=5000):
    draw = random.Random(seed)
    return draw, lambda n: [f"w{draw.randrange(words)}" for _ in range(n)]


def grams(text, k=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def groups(texts, least=0.8):
    """Smallest id of each group under all links of that similarity, by brute force."""
    sets, root = {i: grams(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both and both >= least * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def edited(draw, say, base, edits):
    words = list(base)
    for at in draw.sample(range(len(words)), edits):
        words[at] = say(1)[0]
    return " ".join(words)


def test_similar_documents_go_and_others_stay(spark):
    draw, say = sayer(21)
    bases = [say(150) for _ in range(25)]
    rows = [(i, " ".join(b)) for i, b in enumerate(bases)]
    near, far = set(), set()
    for i, b in enumerate(bases):
        near.add(100 + i)
        far.add(200 + i)
        rows += [(100 + i, edited(draw, say, b, 1)), (200 + i, " ".join(say(75) + b[75:]))]
    rows += [(300 + i, " ".join(bases[0])) for i in range(5)] + [(400, None), (401, ""), (402, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert kept == set(range(25)) | far | {400, 402}
    plain = {r.doc_id for r in simhash.keep_first(docs, similar=None).collect()}
    assert plain >= kept


@pytest.mark.parametrize("families", [20, 120])
def test_links_near_the_threshold_against_brute_force(spark, families):
    """Copies with up to four words changed, about 0.79 similar or more, of texts that all share a long passage; the recall doesn't fall with the number of texts."""
    draw, say = sayer(23)
    shared, texts = say(60), {}
    for f in range(families):
        base = say(80) + shared + say(40)
        for k in range(4):
            texts[len(texts)] = edited(draw, say, base, draw.randrange(1, 5) if k else 0)
    order = list(texts)
    draw.shuffle(order)
    texts = {order[i]: t for i, t in texts.items()}
    exact = groups(texts)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_first(docs).collect()}
    gone, known = set(texts) - exact, set(texts) - kept
    assert len(gone) > families and len(gone & known) >= 0.95 * len(gone)
    assert len(known - gone) <= 0.01 * len(texts)


def test_a_large_group_of_near_copies_is_one_group(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT", 10)
    draw, say = sayer(22)
    base = say(200)
    texts = {i: edited(draw, say, base, draw.randrange(0, 4)) for i in range(300)} | {1000 + i: " ".join(say(200)) for i in range(20)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert {r.doc_id for r in simhash.keep_first(docs).collect()} == groups(texts)


def test_links_of_a_large_group_grow_with_its_size(spark):
    draw, say = sayer(24)
    base = say(120)

    def links(n):
        rows = [(i, edited(draw, say, base, 1)) for i in range(n)]
        prints = simhash.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), bands=simhash.BANDS)
        return simhash.met(prints.select(F.col("doc_id").alias("node"), F.explode("bands").alias("cell")), F.col("node")).count()

    small, large = links(50), links(200)
    # the number of pairs would grow sixteenfold; each document has a link a cell at most
    assert small < large <= simhash.BANDS * 200 and large < 10 * small


def test_texts_of_one_id_are_told_apart(spark):
    draw, say = sayer(25)
    a, b, c = (" ".join(say(60)) for _ in range(3))
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (1, a, "x"), (3, b, "y"), (None, a, "z"), (None, a, "z"), (4, None, "n"), (5, "", "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    kept = sorted((r.doc_id or 0, r.text or "", r.node) for r in simhash.keep_first(docs).collect())
    assert kept == sorted([(1, a, "x"), (1, b, "x"), (2, c, "x"), (0, a, "z"), (0, a, "z"), (4, "", "n")])


@pytest.mark.parametrize("width", [1, 2])
def test_segment_width_changes_no_link(spark, width):
    draw = random.Random(5)
    values = [draw.getrandbits(64) for _ in range(30)]
    for v in list(values):
        values += [v ^ sum(1 << b for b in draw.sample(range(64), k)) for k in (1, 2, 3, 4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    found = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), width).collect()}
    mask = (1 << 64) - 1
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def written(spark):
    """Files of rows in the checkpoint folder."""
    return sum(x.name.startswith("part-") for x in Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("*"))


@pytest.mark.parametrize("query", [simhash.near_duplicates, lambda docs: simhash.keep_first(docs, similar=None)])
def test_few_rows_of_many_tasks_become_few_files(spark, query):
    draw, say = sayer(31)
    docs = spark.createDataFrame([(i, " ".join(say(30))) for i in range(60)], "doc_id long, text string").repartition(40)
    before = written(spark)
    found = query(docs)
    assert written(spark) - before < 20 and found.count() == 60
