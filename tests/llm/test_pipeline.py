import os
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from proseline.llm import packing, queries, simhash

SF = "/root/testdata/sf0.001"
ALPHABETS = {"en": "abcdefgh", "de": "ijklmnop", "fr": "qrstuvwx"}


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus():
    """Documents of three languages with copies, near copies, passages that documents share, and what no language is."""
    draw, texts = random.Random(61), {}

    def say(lang, n):
        return ["".join(draw.choice(ALPHABETS[lang]) for _ in range(draw.randrange(3, 9))) for _ in range(n)]

    shared = {lang: [say(lang, n) for n in (50, 64, 49, 120)] for lang in ALPHABETS}
    langs = {}
    for i in range(90):
        lang = list(ALPHABETS)[i % 3]
        own = say(lang, draw.randrange(30, 260))
        for p in draw.sample(shared[lang], draw.choice([0, 0, 1, 2])):
            own += [*p, *say(lang, draw.randrange(3, 20))]
        texts[i], langs[i] = own, lang
    for i in range(90, 120):
        base = draw.randrange(0, 60)
        own = list(texts[base])
        for at in draw.sample(range(len(own)), i % 3):
            own[at] = say(langs[base], 1)[0]
        texts[i], langs[i] = own, langs[base]
    rows = {i: " ".join(w) for i, w in texts.items()} | {200: None, 201: "", 202: "123 456 , ."}
    half = [*say("en", 60), *say("de", 60), *say("fr", 60)]
    rows[203] = " ".join(half)
    return [(i, t, langs.get(i), None if i % 17 == 3 else f"s{i % 4}", len(t or "")) for i, t in rows.items()]


def plain_near_duplicates(docs):
    """Ids that stay under all links: three bits of a print, or five-word similarity of 0.8, pair by pair."""
    prints = {i: simhash.fingerprint((t or "").encode()) for i, t in docs.items()}
    own = {i: words_of((t or "").lower()) for i, t in docs.items()}
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for i, w in own.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sorted(docs):
        for b in sorted(docs):
            both = len(grams[a] & grams[b])
            if a < b and ((prints[a] ^ prints[b]).bit_count() <= 3 or both and both >= 0.8 * (len(grams[a]) + len(grams[b]) - both)):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i for i in docs if find(i) == i}


def plain_without_passages(docs, least=50):
    """Words of each document outside of windows that a document of smaller id has too; what has none left goes."""
    first, out = {}, {}
    own = {i: words_of(t) for i, t in docs.items()}
    at = lambda w, k: tuple(x.lower() for x in w[k : k + least])
    for i in sorted(own):
        for k in range(len(own[i]) - least + 1):
            first.setdefault(at(own[i], k), i)
    for i, w in own.items():
        gone = {p for k in range(len(w) - least + 1) if first[at(w, k)] < i for p in range(k, k + least)}
        left = [x for p, x in enumerate(w) if p not in gone]
        if left or not gone:
            out[i] = left
    return out


def best_fit(lengths, capacity=1024):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in room if x >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


def test_stages_equal_plain_versions(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}

    known = corpus_pipeline.store(stages["language"](spark, docs, str(tmp_path)))
    told = texts(known)
    assert set(told) == {i for i, _, lang, *_ in rows if lang}

    single = corpus_pipeline.store(stages["near_duplicates"](spark, known, str(tmp_path)))
    assert set(texts(single)) == plain_near_duplicates(told)

    unique = corpus_pipeline.store(stages["repeated_passages"](spark, single, str(tmp_path)))
    assert {i: words_of(t) for i, t in texts(unique).items()} == plain_without_passages(texts(single))
    assert all(r.n_chars == len(r.text) for r in unique.collect())

    mixed = corpus_pipeline.store(stages["mixture"](spark, unique, str(tmp_path)))
    db = duckdb.connect()
    db.register("documents", unique.toPandas())
    taken = {i: n for i, n in db.execute(f"SELECT doc_id, taken FROM ({queries.OP4_SQL})").fetchall() if n}
    found, before = Counter(), texts(unique)
    for r in mixed.collect():
        found[r.doc_id] += len(words_of(r.text))
        assert not Counter(words_of(r.text)) - Counter(words_of(before[r.doc_id]))
    assert found == Counter(taken)

    packed = stages["sequences"](spark, mixed, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    lengths = [len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect()]
    pieces = [n for length in lengths for n in packing.cut_lengths(length)]
    assert Counter(r.length for r in packed) == Counter(pieces)
    assert len({r.sequence_id for r in packed}) == best_fit(pieces)
    by = defaultdict(list)
    for r in packed:
        by[r.sequence_id].append((r.offset, r.length))
    assert all(sum(n for _, n in x) <= 1024 and [o for o, _ in sorted(x)] == [sum(n for o2, n in x if o2 < o) for o, _ in sorted(x)] for x in by.values())

    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    piece = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert Counter(map(piece, whole)) == Counter(map(piece, packed))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stages_hand_on_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], SF)
        assert out.columns == columns, name
        seen.append(corpus_pipeline.store(out))
    ids = [{r.doc_id for r in x.select("doc_id").collect()} for x in seen]
    assert all(b <= a for a, b in zip(ids, ids[1:], strict=False))
    packed = corpus_pipeline.STAGES[-1][1](spark, seen[-1], SF).collect()
    assert {r.doc_id for r in packed} == ids[-1]


def test_extra_columns_and_repeated_rows_pass(spark):
    rows = [(1, "one two three four five six", "en", "a", 27, "x", 1), (1, "one two three four five six", "en", "a", 27, "x", 1), (2, None, None, None, None, None, None), (None, "six five four three two one", "en", "a", 27, "y", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, spans string, begin int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert all(r.spans in ("x", "y", None) for r in out.collect())
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert len(corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()) == 4
