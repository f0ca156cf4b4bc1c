"""Each operator against brute force, a round trip or planted cases, with nulls, empty and long texts, ties and extra columns."""

import hashlib
import os
import random
import re
import struct
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from proseline.llm import chat, langid, licenses, media, mixing, packing, pages, quality, simhash, suffix
from proseline.llm.graph import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=DOCS):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def sentence(draw, n, words=400):
    return " ".join(f"w{draw.randrange(words)}" for _ in range(n))


def cases():
    draw = random.Random(1)
    base = [sentence(draw, 120) for _ in range(8)]
    edited = [t.replace(t.split()[5], "changed", 1) for t in base[:4]]
    return [*base, base[0], base[0], *edited, None, "", " \n\t ", "one", "One", "a b c", sentence(draw, 30_000, 50)]


def slow_fingerprint(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def test_simhash_equals_brute_force(spark):
    texts = cases()
    found = simhash.near_duplicates(frame(spark, texts)).collect()
    prints = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert {r.doc_id: int(r.fingerprint, 16) for r in found} == prints
    group = dict(zip(prints, prints, strict=True))
    for _ in prints:
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3:
                    group[a] = group[b] = min(group[a], group[b])
    assert {r.doc_id: r.component_id for r in found} == group


def test_simhash_links_find_all_pairs_at_three_bits(spark):
    draw = random.Random(5)
    values = [draw.getrandbits(64) for _ in range(30)]
    for v in list(values):
        for k in (1, 2, 3, 4):
            values.append(v ^ sum(1 << b for b in draw.sample(range(64), k)))
    signed = [v - (1 << 64) if v >> 63 else v for v in set(values)]
    found = {frozenset((r.a, r.b)) for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()}
    mask = (1 << 64) - 1
    assert found == {frozenset((a, b)) for a in signed for b in signed if a < b and ((a ^ b) & mask).bit_count() <= 3}


def test_components_of_paths_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 9)] + [(5, 5), (7, 6)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(9)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_keep_first_keeps_columns_and_null_ids(spark):
    df = spark.createDataFrame([(2, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (None, "z", "n")], "doc_id long, text string, begin string")
    assert sorted((r.doc_id or 0, r.begin) for r in simhash.keep_first(df).collect()) == [(0, "n"), (1, "y")]


def test_media_round_trip(spark):
    texts = ["", None, "é" * 33, "x" * 64, "a\0b", "long " * 5000]
    found = {r.doc_id: r for r in media.describe(media.text_images(frame(spark, texts))).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data.ljust(max(64, -(-len(data) // 64) * 64), b"\0")
        r = found[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert (r.payload_sha256, r.tail_crc32) == (hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored = media.payload_image(data)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert found[0].feature == found[1].feature
    bad = spark.createDataFrame([(1, b"junk"), (2, None)], "doc_id long, media binary")
    assert [r.feature for r in media.describe(bad).collect()] == [None, None]


@pytest.mark.parametrize("shape", [(8, 9), (3, 5), (20, 64), (1, 64), (17, 13)])
def test_area_resize_is_the_mean_of_areas(shape, monkeypatch):
    monkeypatch.setattr(media, "STRIP", 4)
    pixels = np.random.default_rng(0).integers(0, 256, shape).astype(np.uint8)
    small = media.resize(pixels, 4, 6)
    fine = np.repeat(np.repeat(pixels.astype(int), 4, 0), 6, 1).reshape(4, shape[0], 6, shape[1]).sum((1, 3))
    assert (small == fine // (shape[0] * shape[1])).all()


def test_image_formats():
    grey = np.arange(12, dtype=np.uint8).reshape(3, 4)
    colour = np.random.default_rng(1).integers(0, 256, (5, 3, 3)).astype(np.uint8)
    for x in (grey, colour, grey.astype(np.uint16) * 999):
        assert (media.decode(media.encode_netpbm(x)) == x).all()
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P2 # note\n4 3\n255\n" + b" ".join(b"%d" % v for v in range(12))) == grey).all()
    assert media.decode(b"P1\n3 2\n1 0 1\n0 1 0").tolist() == [[1, 0, 1], [0, 1, 0]]
    assert media.decode(b"P4\n3 2\n\xa0\x40").tolist() == [[1, 0, 1], [0, 1, 0]]
    with pytest.raises(ValueError, match="early"):
        media.decode(b"P5\n4 4\n255\nabc")
    head = b"BM" + struct.pack("<IHHI", 90, 0, 0, 66) + struct.pack("<IiiHHIIiiII", 40, 3, 5, 1, 32, 3, 24, 0, 0, 0, 0)
    wide = colour[::-1].astype("<u4")
    for masks, values in (((0xFF0000, 0xFF00, 0xFF), wide[:, :, 0] << 16 | wide[:, :, 1] << 8 | wide[:, :, 2]), ((0xFF, 0xFF00, 0xFF0000), wide[:, :, 2] << 16 | wide[:, :, 1] << 8 | wide[:, :, 0])):
        assert (media.decode(head + struct.pack("<III", *masks) + values.astype("<u4").tobytes()) == colour).all()


def test_bad_images_are_null(spark):
    bad = [b"P2\n2 2\n255\n1 2 3 99999999999", b"P5\n0 0\n255\n", b"P1\n2 2\n1 0 7 1", b"BM" + bytes(60), b"P6\n99999 99999\n255\nabc", b"P3\n1 1\n255\n-1 0 0", b"", b"P4\n9 9\n", b"P5\n9999999999999 1\n255\n", None]
    found = media.describe(spark.createDataFrame(list(enumerate(bad)), "doc_id long, media binary")).collect()
    assert [(r.feature, r.tile, r.media_bytes) for r in found] == [(None, None, None)] * len(bad)


def slow_repeats(words):
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    return len({j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)})


def test_quality_counts(spark):
    draw = random.Random(2)
    texts = [sentence(draw, 200, 3), "x y\nx y\n \n\nx y", "a# b*| <é>\t&", None, "", sentence(draw, 60), "w " * 3000]
    found = {r.doc_id: r for r in quality.judge(frame(spark, texts), spark.createDataFrame([], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), slow_repeats(words))
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert r.kept == (not r.base_failed)


def test_quality_forest_parts_labelled_rows(spark):
    draw = random.Random(4)
    good = [sentence(draw, draw.randrange(60, 300)) + "." for _ in range(80)]
    bad = [" ".join(f"w{draw.randrange(400)}###" for _ in range(100)) for _ in range(20)]
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(0, 100, 2)] + [(None, 1), (999, 0)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(frame(spark, good + bad), labels).collect() if r.kept}
    assert kept >= set(range(80)) - {1} and not kept & set(range(80, 100))


def test_sainte_lague_takes_the_highest_quotients():
    draw = random.Random(6)
    for _ in range(50):
        values = [draw.choice([0, draw.randrange(1, 9), draw.randrange(1, 5000)]) for _ in range(draw.randrange(1, 9))]
        seats = draw.randrange(0, 60)
        ranked = sorted(((-v / (2 * k + 1), i) for i, v in enumerate(values) if v for k in range(seats)))[:seats]
        want = Counter(i for _, i in ranked)
        assert mixing.sainte_lague([float(v) for v in values], seats) == [want[i] if sum(values) else 0 for i in range(len(values))]


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD", 7)
    draw = random.Random(8)
    rows = [(i, sentence(draw, draw.randrange(0, 90)), draw.choice(["a", "b", "é", None])) for i in range(120)] + [(500, None, "a"), (1, "again and again", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.mix(docs).collect()
    assert sorted(map(str, found)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=str) + [None]
    goal = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    assert len(found) == len(rows) and all(0 <= r.taken <= 2 * r.size for r in found)
    for s in order:
        own = [r for r in found if r.source == s]
        assert {(r.source_size, r.target) for r in own} == {(sizes[s], goal[s])}
        assert abs(sum(r.taken for r in own) - goal[s]) <= 16 * (2 + 2 * (len(own) // 7 + 1))
    mixed = mixing.mixed_documents(docs).collect()
    assert sum(len(r.text.split()) for r in mixed) == sum(r.taken for r in found)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_targets_reshare_the_excess():
    assert mixing.targets([100, 100, 100]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def check_packing(found, lengths):
    by = defaultdict(list)
    for r in found:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert sum(r.length for r in found) == sum(lengths)
    return len(by)


def test_the_encoder_learns_a_word_it_remembers_once(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    encoder, learned = packing.Encoder(packing.default_vocabulary()), []
    letters = encoder.letters
    monkeypatch.setattr(encoder, "letters", lambda word: learned.append(word) or letters(word))
    first = {f"word{x}" for x in "abcdefgh"}
    encoder.learn(first)
    encoder.learn(first | {"next"})
    assert sorted(learned) == sorted(first | {"next"})
    encoder.learn({"worda", "wordb", "one", "two", "three"})
    assert sorted(learned[9:]) == ["one", "three", "two"] and len(encoder.known) == 5
    assert encoder.many(["x worda one longer text, worda"]) == [encoder.ids("x worda one longer text, worda")]


def test_packing(spark):
    texts = [*cases(), "  two  spaces ", "tab\tand\nline \n end", "don't  stop'll", "é ü x   y", "a" * 300 + " b", "<|endoftext|> x"]
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_vocabulary())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)}
    found = packing.pack(frame(spark, texts), with_ids=True).collect()
    check_packing(found, map(len, ids.values()))
    for r in found:
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()
        assert (bytes(r.ids), r.ids_crc32) == (own, zlib.crc32(own))
    for i, x in ids.items():
        own = sorted((r.piece, r.start, r.length) for r in found if r.doc_id == i)
        assert [p[0] for p in own] == list(range(len(own))) and all(p[2] == 1024 for p in own[1:])
        assert len(own) == max(1, -(-len(x) // 1024))


def test_plan_is_best_fit_decreasing():
    draw = random.Random(9)
    for _ in range(20):
        lengths = [draw.randrange(1, 1025) if draw.random() < 0.6 else draw.choice([3, 340, 700]) for _ in range(draw.randrange(0, 300))]
        room, want = [], 0
        for n in sorted(lengths, reverse=True):
            fits = [x for x in room if x >= n]
            if fits:
                room.remove(min(fits))
                room.append(min(fits) - n)
            else:
                want += 1
                room.append(1024 - n)
        runs = packing.plan(dict(Counter(lengths)))
        used = {first + i // each for _, since, until, each, first, _ in runs for i in range(until - since)}
        assert len(used) == want
        assert Counter({n: 0 for n in lengths} | {}) + Counter(dict(Counter(lengths))) == sum((Counter({n: b - a}) for n, a, b, *_ in runs), Counter())


def test_suffix_repeats_equal_brute_force(spark):
    draw = random.Random(11)
    shared = [sentence(draw, n, 10_000).split() for n in (50, 51, 64, 200, 49, 40)]
    texts = []
    for _ in range(30):
        words = sentence(draw, draw.randrange(20, 200), 10_000).split()
        for p in draw.sample(shared, draw.randrange(0, 3)):
            words += [*p, *sentence(draw, draw.randrange(1, 30), 10_000).split()]
        texts.append(" ".join(words))
    texts += [texts[0], None, "", "short", "echo " * 200]
    seen = defaultdict(set)
    for i, t in enumerate(texts):
        w = (t or "").split()
        for j in range(len(w) - 49):
            seen[tuple(w[j : j + 50])].add(i)
    want = {}
    for i, t in enumerate(texts):
        w = (t or "").split()
        if own := {k for j in range(len(w) - 49) if len(seen[tuple(w[j : j + 50])]) > 1 for k in range(j, j + 50)}:
            want[i] = own
    found = {r.doc_id: {k for s in r.spans for k in range(s.start, s.end)} for r in suffix.repeated(frame(spark, texts)).collect()}
    assert found == want
    left = {r.doc_id: r.text for r in suffix.remove_repeated(frame(spark, texts)).collect()}
    assert 30 not in left and left[31] is None and left[32] == ""
    again = defaultdict(set)
    for i, t in left.items():
        w = (t or "").split()
        for j in range(len(w) - 49):
            again[tuple(w[j : j + 50])].add(i)
    assert all(len(x) == 1 for x in again.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href=x>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div><header>Top</header>
<article><h1>Head &amp; line</h1><p>One  <b>bold</b>word.<br><p>Two&nbsp;three &lt;x&gt;</p><aside>Side</aside><form>F</form>
<div class="comments"><p>First!</p></div><ul><li>i<li>j</ul></article><footer>&copy; me</footer></body></html>"""


def test_pages(spark):
    shared = "these eight or more words stand on both pages of the host"
    rows = [
        (1, "http://a/1", PAGE), (2, "http://a/2", None), (3, None, ""), (4, "http://b/1", f"<div>{shared}</div><p>only here</p>"),
        (5, "http://B:80/2", f"<div>{shared}</div><p>and there</p>"), (6, "http://c/1", f"<div>{shared}</div>"), (7, "http://d", "<article><p>cut sho &am"),
    ]
    found = {r.page_id: r for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert found[1].text == "Head & line\n\nOne boldword.\n\nTwo three <x>\n\ni\n\nj"
    assert [found[i].text for i in (2, 3, 4, 5, 6, 7)] == ["", "", "only here", "and there", shared, "cut sho &am"]
    assert all(r.n_chars == len(r.text) for r in found.values())


def test_licenses(spark):
    mit = "The MIT License (MIT)\n\nCopyright (c) 2020 Somebody\n" + licenses.TEXTS["MIT"].replace("license", "licence").upper()
    texts = [mit, "prose\nReleased under the MIT Licence!\nprose", "no license here", None, "", licenses.NOTICES[-1][1], "MIT License", "// SPDX-License-Identifier: BSD-3-Clause\nint x;", "x " * 50_000]
    want = {(0, "MIT", "text", 1), (1, "MIT", "notice", 1), (5, "Apache-2.0", "notice", 1), (7, "BSD-3-Clause", "notice", 1)}
    for width in (50, 61, 62, 70, 80, 81, 82):
        for k, body in licenses.TEXTS.items():
            lines = "\n\n".join(textwrap.fill(x, width, break_long_words=False, break_on_hyphens=False) for part in body.split("\n\n") for x in part.split("\n"))
            want.add((len(texts), k, "text", 1))
            texts.append(f"Copyright 1999-2003 A. Uthor <a@b.c>\nCopyright © 2004 B\nAll rights reserved.\n\n{lines}\n")
    found = {(r.doc_id, r.licence, r.scope, r.n_found) for r in licenses.scan(frame(spark, texts)).collect()}
    assert found == want
    own = [licenses.known_text("House", "text", "Ask before you copy this.")]
    found = licenses.scan(frame(spark, ["ask: before YOU copy this", mit]), own).collect()
    assert [(r.doc_id, r.licence) for r in found] == [(0, "House")]
    assert licenses.scan(frame(spark, [mit]), []).count() == 0


@pytest.mark.skipif(not os.path.isdir("/usr/share/common-licenses"), reason="no licence texts here")
@pytest.mark.parametrize("name", ["Apache-2.0", "GPL-2", "GPL-3", "LGPL-2.1", "LGPL-3", "MPL-2.0", "CC0-1.0"])
def test_digests_of_long_licences(name):
    text = open(f"/usr/share/common-licenses/{name}", encoding="utf-8").read()
    digests = {k: d for k, (d, _) in licenses.DIGESTS.items()}
    assert licenses.known_text("x", "text", text).digest == digests.get(name, digests.get(f"{name}.0"))


def test_template_language():
    render = chat.compile_template("{% set n = 'a' ~ 1 %}{{ n }}{% for x in xs %}{% if x.k > 1 and not x.z %}[{{ x['k'] }}]{% elif x.z %}z{% else %}-{% endif %}{% endfor %}{# note #}{{ none }}")
    assert render({"xs": [{"k": 1}, {"k": 2}, {"z": True, "k": 0}]})[0] == "a1-[2]z"
    assert chat.fold(chat.parse("a{{ 'b' ~ 2 }}{% if 1 == 1 %}c{% endif %}")) == chat.Node("body", None, (chat.Node("text", "ab2c"),))
    for bad in ("{% if x %}", "{{ x.y( }}", "{{ open('f') }}", "{{ x | nothing }}", "{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(TypeError):
        chat.compile_template("{{ x.__class__ }}")({"x": "s"})


def test_chats_read_back(spark):
    said = ["<|im_end|><|im_start|>assistant ok", "a\\b<|<\\|n\\n", "", None, "<", "\n|>"]
    rows = [(c, t, ("user", "assistant", "system")[(c + t) % 3], said[(c * 2 + t) % 6]) for c in range(6) for t in range(c + 1)]
    rows += [(None, 0, None, "x"), (None, None, "assistant", "y\nz")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").unionByName(chat.control_chat(spark))
    found = {r.conv_id: r for r in chat.read_back(chat.format_chats(turns)).collect()}
    want = defaultdict(list)
    for c, t, role, text in [*rows, (-1, 0, "user", said[0]), (-1, 1, "assistant", said[0])]:
        want[c].append((-1 if t is None else t, role or "", text or ""))
    assert set(found) == set(want)
    for c, own in want.items():
        whole = "".join(f"{role}\n{text}\n" for _, role, text in sorted(own))
        loss = "".join(text for _, role, text in sorted(own) if role == "assistant")
        r = found[c]
        assert (r.n_turns, r.turns_sha256) == (len(own), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_language_mixtures(spark):
    draw = random.Random(12)
    words = {"en": ["the", "house", "which", "with", "there"], "de": ["der", "straße", "nicht", "durch", "über"], "fr": ["où", "était", "maison", "ça", "deçà"]}
    say = lambda lang, n: " ".join(draw.choice(words[lang]) for _ in range(n))
    rows = [(i, say(lang, draw.randrange(3, 60)), lang, "s", 0) for i, lang in enumerate(list(words) * 30)]
    rows += [(900, None, "en", "s", 0), (901, "123 .", "de", "s", 0), (902, say("en", 60) + " " + say("de", 40), None, "s", 0), (903, "", None, "s", 0)]
    found = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(found[i].lang_pred == lang for i, _, lang, *_ in rows if i < 900)
    assert [found[i].lang_pred for i in (900, 901, 903)] == ["und"] * 3
    assert {x.lang: round(x.share, 1) for x in found[902].langs} == {"en": 0.6, "de": 0.4}
    assert all(0 <= r.score <= 1 for r in found.values())
    nothing = langid.identify(spark.createDataFrame([(1, "text", None, "s", 0)], DOCS)).first()
    assert (nothing.lang_pred, nothing.score) == ("und", 0.0)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    results = [
        simhash.near_duplicates(none), simhash.keep_first(none), media.describe(media.text_images(none)), quality.judge(none, labels),
        mixing.mix(none), mixing.mixed_documents(none), packing.pack(none), suffix.repeated(none), suffix.remove_repeated(none),
        licenses.scan(none), langid.identify(none), langid.known_language(none),
        pages.extract(spark.createDataFrame([], "page_id long, url string, html string")),
        chat.read_back(chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))),
    ]
    assert [r.count() for r in results] == [0] * len(results)
