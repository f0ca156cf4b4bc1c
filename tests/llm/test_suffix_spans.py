import random

from proseline.llm import common, suffix

LEAST = 50


def covered(texts, later_only=False):
    """Places of words in windows of LEAST words that another document has too (later_only: one of smaller doc_id)."""
    words = {i: t.split() for i, t in texts.items()}
    own = {i: [tuple(w[k : k + LEAST]) for k in range(len(w) - LEAST + 1)] for i, w in words.items()}
    seen = {}
    for i, found in own.items():
        for x in found:
            seen.setdefault(x, set()).add(i)
    out = {}
    for i, found in own.items():
        at = [k for k, x in enumerate(found) if (min(seen[x]) < i if later_only else len(seen[x]) > 1)]
        if at:
            out[i] = {p for k in at for p in range(k, k + LEAST)}
    return out


def spans(spark, texts, **more):
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {r.doc_id: {p for s in r.spans for p in range(s.start, s.end)} for r in suffix.repeated(docs, **more).collect()}


def sayer(seed):
    draw = random.Random(seed)
    return lambda n: " ".join(f"w{draw.randrange(100000)}" for _ in range(n))


def test_passage_repeated_in_one_document(spark):
    say, texts = sayer(31), {}
    for i in range(40):
        shared = say(51 + i % 20)
        texts[2 * i] = f"{say(30)} {shared} {say(30)}"
        texts[2 * i + 1] = " ".join(f"{say(20)} {shared}" for _ in range(2 + i % 3)) + " " + say(20)
    assert spans(spark, texts) == covered(texts)


def test_overlaps_of_many_documents_are_found_whole(spark):
    draw, say = random.Random(33), sayer(33)
    pools, texts = [say(160).split() for _ in range(4)], {}
    for i in range(120):
        parts = [say(12)]
        for _ in range(3):
            pool, at = pools[draw.randrange(4)], draw.randrange(100)
            parts += [" ".join(pool[at : at + draw.randrange(40, 90)]), say(12)]
        texts[i] = " ".join(parts)
    assert spans(spark, texts) == covered(texts)
    assert spans(spark, texts, later_only=True) == covered(texts, later_only=True)


def test_short_overlaps_in_a_row_are_no_passage(spark):
    say, texts = sayer(35), {}
    for i in range(20):
        words = say(60).split()
        texts[3 * i] = " ".join(words)
        texts[3 * i + 1] = f"{say(10)} {' '.join(words[:45])} {say(10)}"
        texts[3 * i + 2] = f"{say(10)} {' '.join(words[15:])} {say(10)}"
    assert spans(spark, texts) == {}


def test_a_hot_passage_is_split(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(common, "HOT", 4)
    say = sayer(36)
    hot, texts = say(70), {}
    for i in range(120):
        texts[i] = f"{say(15)} {hot} {say(15)}" if i % 3 == 0 else say(80)
    assert spans(spark, texts) == covered(texts)


def test_very_long_texts(spark):
    say = sayer(37)
    hot = say(60)
    texts = {1: f"{say(60000)} {hot} {say(40000)}", 2: f"{hot} {say(80000)}", 3: say(100)}
    assert spans(spark, texts) == {1: set(range(60000, 60060)), 2: set(range(60))}


def test_later_only_leaves_each_passage_in_a_document(spark):
    say, texts = sayer(34), {}
    for i in range(30):
        shared, more, short, end = say(60), say(14), say(40), say(14)
        texts[10 * i + 1] = f"{say(20)} {shared} {say(20)} {short} {say(20)}"
        texts[10 * i + 5] = f"{say(20)} {shared} {more} {say(20)} {short} {end} {say(20)}"
        texts[10 * i + 9] = f"{say(20)} {shared} {more} {say(20)} {short} {end} {say(20)}"
    assert spans(spark, texts, later_only=True) == covered(texts, later_only=True)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = {w for r in suffix.remove_repeated(docs).collect() for w in r.text.split()}
    assert left == {w for t in texts.values() for w in t.split()}
