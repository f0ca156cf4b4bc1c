import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from proseline.operators import cleaning, dedup, reports, resample, scoring, votes
from proseline.plans import ballots
from proseline.plans.scores import SPREADS


def test_elo_goldens():
    assert votes.rate([("a", "b", "win")])[0] == {"a": 1516, "b": 1484}
    assert votes.rate([("a", "b", "both")])[0] == {"a": 1500, "b": 1500}
    assert votes.rate([("a", "b", "win"), ("a", "b", "both")])[0] == {"a": 1515, "b": 1485}
    assert votes.rate([("a", "b", "win"), ("b", "c", "win"), ("c", "a", "win")])[0] == {"a": 1498, "b": 1501, "c": 1501}


def test_rate_limit_counts_from_the_last_counted_vote(spark):
    rows = [(i, t, "x", "f") for i, t in enumerate((0, 1000, 1600, 3200))] + [(9, 500, "y", "f")]
    found = votes.rate_limit(spark.createDataFrame(rows, "seq int, t bigint, iph string, fp string"))
    assert {r.seq: r.reason for r in found.collect()} == {0: None, 1: "rate", 2: None, 3: None, 9: None}


def test_daily_cap_counts_rejected_votes(spark):
    rows = [(i, i * 2000, "x", "f") for i in range(6)]
    found = votes.rate_limit(spark.createDataFrame(rows, "seq int, t bigint, iph string, fp string"), per_pair=3)
    assert [r.reason for r in sorted(found.collect())] == [None] * 3 + ["daily_cap"] * 3


def test_tie_groups_are_those_of_the_board(spark):
    found = resample.tie_groups(spark.createDataFrame(SPREADS, "model string, place int, best int, worst int")).collect()
    sizes = [sum(r.tie_group == g for r in found) for g in (1, 2, 3, 4)]
    assert sizes == [1, 5, 6, 6]
    assert next(r.tie_group for r in found if r.model == "deepseek-v4-pro") == 3


def test_messages(spark):
    text = "Hi Jo,\n\nbody one\n\nThanks\n\nheadless\n\na@b on 1/2/2001\n\nDear all,\n\nmore\n\nJo"
    long = "\n\n".join(["Hey you", *(f"block {i}" for i in range(45)), "Thanks", "Thanks", "tail " * 800, "Jo"])
    files = spark.createDataFrame([("a", text), ("b", "Thanks"), ("c", None), ("d", long)], "path string, text string")
    found = {}
    for r in cleaning.segment(files).orderBy("path", "position").collect():
        found.setdefault(r.path, []).append(r.text)
    assert found["a"] == ["Hi Jo,\n\nbody one\n\nThanks", "headless", "Dear all,\n\nmore\n\nJo"]
    blocks = [f"block {i}" for i in range(45)]
    assert found["d"] == ["\n\n".join(["Hey you", *blocks[:39]]), "\n\n".join([*blocks[39:], "Thanks"]), "tail " * 800]
    assert set(found) == {"a", "d"}


def test_block_kinds(spark):
    kinds = {"hello there": "greeting", "Jo Ann,\nx": "greeting", "Jo,\nx\ny": "body", "Best": "signoff", "best regards,": "signoff", "Jo\nsee": "signoff",
             "x\n1/2/2001 10:30 AM\ny": "noise", "a@b.c on 1/2/01": "noise", "some text": "body"}
    df = spark.createDataFrame(list(kinds.items()), "b string, kind string")
    assert df.where(cleaning.block_kind(F.col("b")) != F.col("kind")).collect() == []


def test_clean_message(spark):
    raw = "keep\n> quote\nFrom: x\nthis is confidential\n________\nrest\n--- forwarded by ---\ngone"
    df = spark.createDataFrame([(raw,)], "text string")
    assert df.select(cleaning.clean_message(F.col("text"))).first()[0] == "keep\nrest"
    chat = spark.createDataFrame([("> a `code` b ```py\nx\n```  c",)], "text string")
    assert chat.select(cleaning.clean_chat(F.col("text"))).first()[0] == "a b c"
    post = spark.createDataFrame([("see https://x.y/z &amp; more",)], "text string")
    assert post.select(cleaning.clean_post(F.col("text"))).first()[0] == "see & more"
    essay = spark.createDataFrame([("it\x92s  urlLink \x81 here",)], "text string")
    assert essay.select(cleaning.clean_essay(F.col("text"))).first()[0] == "it’s \x81 here"


def test_first_failing_stage_of_each_corpus(spark):
    prose = "We are going to the shop and you will have all of it there, so please do not wait for me. " * 12
    cases = [
        ("essay", "Take this quiz !", "x", "template"), ("essay", "You are a cat. What cat are you?", "x", "template"), ("essay", prose, prose, None), ("essay", prose, "too short", "word_count"),
        ("social", "RT @someone hello there", "hello there", "retweet"), ("social", "we are here", "we are here", None), ("social", "WE ARE ALL HERE", "WE ARE ALL HERE", "register"),
        ("slack", "!play song", "!play song", "command"), ("slack", "Bob has joined the server", "x", "bot_template"), ("slack", "```code```", "", "code_only"),
        ("slack", "https://x.y/z", "https://x.y/z", "url_only"), ("slack", "it is fine now", "it is fine now", None), ("slack", "это не так важно для всех нас сейчас", "это не так важно для всех нас сейчас", "english"),
        ("email", prose[:400], prose[:400], None), ("email", prose[:400].upper(), prose[:400].upper(), "register"), ("email", None, None, "word_count"),
    ]
    for domain in ("essay", "social", "slack", "email"):
        own = [(raw, text, want) for d, raw, text, want in cases if d == domain]
        df = spark.createDataFrame(own, "raw string, text string, want string")
        tests = cleaning.stages(domain, F.col("raw"), F.col("text"))
        failed = cleaning.first_failure([(n, c) for n, c in tests])
        assert [(r.raw, r.failed) for r in df.withColumn("failed", failed).where("not (failed <=> want)").collect()] == [], domain


def test_character_references_are_decoded(spark):
    import html

    texts = ["&lt;&#39;&#x2019;&hellip;&notit;&amp;lt; &amp &am &unknown; &NotEqualTilde;", "\x80\x85\x9f \x81", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(cleaning.clean_essay(F.col("text"))).collect()]
    assert found == [html.unescape(texts[0]), "€…Ÿ \x81", None]


def test_python_decodes_only_texts_with_an_ampersand(spark):
    df = spark.createDataFrame([("a  b",), ("a &amp; b",), (None,)], "text string")
    assert [r[0] for r in df.select(cleaning.clean_post(F.col("text"))).collect()] == ["a b", "a & b", None]
    plan = df.select(cleaning.clean_post(F.col("text")))._jdf.queryExecution().toString()
    assert "unescape(CASE WHEN" in plan


def test_references_cut_before_their_semicolon_stay(spark):
    texts = ["<title>les&amp;&amp</title>", "&amp;quot; &ampcopy; &#8217;&#x41; &lt;&nosuch; &copy", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = [r[0] for r in df.select(cleaning.clean_essay(F.col("text"), closed=True)).collect()]
    assert found == ["<title>les&&amp</title>", "&quot; &ampcopy; ’A <&nosuch; &copy", None]


def test_turns(spark):
    t = datetime(2024, 1, 1)
    rows = [("c", t, 1, "a", "one two"), ("c", t + timedelta(minutes=5), 2, "a", "three"), ("c", t + timedelta(minutes=16), 3, "a", "late"), ("c", t + timedelta(minutes=17), 4, "b", "x")]
    found = cleaning.turns(spark.createDataFrame(rows, "channel string, ts timestamp, seq int, author string, text string"))
    assert [(r.author, r.text, r.n_messages) for r in found.orderBy("turn").collect()] == [("a", "one two\n\nthree", 2), ("a", "late", 1), ("b", "x", 1)]


def test_funnel_is_conserved(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",), ("a",)], "failed string")
    assert [(r.stage, r.dropped, r.kept) for r in cleaning.funnel(df, ["a", "b"]).collect()] == [("a", 2, 2), ("b", 1, 1)]


def test_near_duplicates_against_a_greedy_loop(spark):
    draw = random.Random(3)
    base = [[f"w{draw.randrange(300)}" for _ in range(60)] for _ in range(6)]
    rows = []
    for i in range(40):
        words = list(base[i % 6])
        for _ in range(draw.randrange(3)):
            words[draw.randrange(60)] = f"n{draw.randrange(99)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "position int, text string")
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in rows}
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8
    pairs = {(r.a, r.b) for r in dedup.exact_similar(df).collect()}
    assert pairs == {(a, b) for a in sets for b in sets if a < b and like(a, b)}
    # one cell for all: every pair is a candidate, and rows are taken in order
    sets_of = dedup.shingle_hashes(df)
    placed = df.select("position", F.lit(0).alias("band"), F.lit(1).alias("key"))
    kept: list[int] = []
    for i in sets:
        if not any(like(k, i) for k in kept):
            kept.append(i)
    gone = {r.position for r in dedup.gone(placed, sets_of).collect()}
    assert sorted(set(sets) - gone) == kept
    # with the bands of signatures, candidates are rows that agree in a band
    signed = {r.position: tuple(r.signature) for r in dedup.signatures(df).collect()}
    meet = lambda a, b: signed[a][:4] == signed[b][:4] or signed[a][4:] == signed[b][4:]
    kept = []
    for i in sets:
        if not any(meet(k, i) and like(k, i) for k in kept):
            kept.append(i)
    assert sorted(r.position for r in dedup.near(df).collect()) == kept


def test_minhash_is_modular(spark):
    import hashlib

    df = spark.createDataFrame([(1, "a b c d e f"), (2, "One two"), (3, ""), (4, None)], "position int, text string")
    shingles = {1: ("a b c d e", "b c d e f"), 2: ("one two",), 3: ("",)}
    found = {r.position: r.signature for r in dedup.signatures(df).collect()}
    assert set(found) == set(shingles)
    for i, own in shingles.items():
        hashed = [int(hashlib.md5(s.encode()).hexdigest(), 16) for s in own]
        assert found[i] == [min((a * h + b) % dedup.PRIME for h in hashed) for a, b in dedup.coefficients()]


def test_empty_and_null_texts_are_no_near_duplicates_of_each_other(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a b c d e f g"), (4, "A b c d e f g")], "position int, text string")
    assert sorted(r.position for r in dedup.near(df).collect()) == [1, 2, 3]


def test_scores_of_hand_made_texts(spark):
    rows = [("m", "email", "s", 2, "we delve in\n\nand out now again"), ("m", "email", "s", 2, "we delve in\n\nand out"), ("m", "email", "t", 9, "other words")]
    outputs = spark.createDataFrame(rows, "model string, domain string, scenario string, band_hi int, text string")
    human = spark.createDataFrame([("email", "a b c d e f\n\ng")], "domain string, text string")
    found = scoring.axes(scoring.scenario_sums(scoring.row_measures(outputs)), scoring.human_profile(human)).first()
    assert found.conciseness == pytest.approx(100.0)
    assert found.templating == pytest.approx(100.0)
    assert found.rhythm == pytest.approx(100 * (1 - 0.5 / 2.5))
    assert found.tells == 50.0


def test_bootstrap_weights_are_multiplicities(spark):
    rows = [("m", "email", "s", 2, "a b c"), ("m", "email", "t", 2, "a b c d e f g h")]
    sums = scoring.scenario_sums(scoring.row_measures(spark.createDataFrame(rows, "model string, domain string, scenario string, band_hi int, text string")))
    human = scoring.human_profile(spark.createDataFrame([("email", "a b\n\nc")], "domain string, text string"))
    draws = spark.createDataFrame([(0, "email", "s", 2)], "rep int, domain string, scenario string, k int")
    twice = sums.join(draws, ["domain", "scenario"])
    found = scoring.axes(twice, human, ("rep", "model", "domain"), F.col("k")).first()
    assert (found.conciseness, found.templating) == (50.0, 100.0)


def test_log_parse_and_blended_scores(spark):
    bench = ballots.log_parse(spark, "").collect()
    assert [(r.model, r.overall, r["rank"], r.spread) for r in bench] == [("mistral-large", 40.6, 1, "1"), ("claude-fable-5", 35.6, 2, "2–3")]
    none = spark.createDataFrame([], "model string, elo bigint")
    scores = {r.model: r.score for r in votes.human_score(spark.createDataFrame(bench), none).collect()}
    assert scores["claude-fable-5"] == pytest.approx(20 + 15 * 2)
    guard = reports.budget_guard(spark.createDataFrame([("r", 70.0)], "run string, cost double"), 100.0, 20.0).first()
    assert (guard.remaining, guard.rejected, guard.warned) == (30.0, False, True)


def test_people_without_words_have_no_rates(spark):
    human = scoring.human_profile(spark.createDataFrame([("email", "...")], "domain string, text string")).first()
    assert human.human_delve is None and human.human_spread is None


def test_kinds_and_admission(spark):
    models = spark.createDataFrame([("m", "x", None), ("m", "", None), ("n", "y", "failed"), ("n", "z", "")], "model string, text string, error string")
    people = spark.createDataFrame([("src", "w")], "source string, text string")
    both = scoring.both_kinds(scoring.admitted(models), people)
    assert sorted(r.text for r in scoring.of_kind(both, "model").collect()) == ["x", "z"]
    assert [r.text for r in scoring.of_kind(both, "human").collect()] == ["w"]
    untagged = spark.createDataFrame([("a", None), ("b", "human")], "text string, kind string")
    assert [r.text for r in scoring.of_kind(untagged, "model").collect()] == ["a"]


def test_token_gate(spark):
    base = dict(w="b", l="a", fp="f", scenario="s", attention=False, dwell=9999, t=10_000_000, session_kind="sess", session_end=10_000_000, pair_kind="pair", pair_a="a", pair_b="b", pair_t=10_000_000 - 5000)
    cases = [
        ({}, None), ({"session_kind": None}, "no_session"), ({"session_end": 9_999_999}, "no_session"), ({"session_end": None}, "no_session"), ({"pair_a": "b", "pair_b": "a"}, "bad_pair"),
        ({"pair_kind": "x"}, "bad_pair"), ({"pair_t": 10_000_000 - 1_800_001}, "bad_pair"), ({"pair_t": 10_000_000 - 1_800_000}, None), ({"pair_t": None}, "bad_pair"),
        ({"pair_t": 10_000_000 - 1199}, "too_fast"), ({"attention": True, "session_kind": None, "pair_kind": None}, "attention"), ({"fp": "f" * 81}, "too_long"), ({"w": "z"}, "unknown_model"),
    ]
    schema = "w string, l string, fp string, scenario string, attention boolean, dwell long, t long, session_kind string, session_end long, pair_kind string, pair_a string, pair_b string, pair_t long, n int"
    df = spark.createDataFrame([tuple((base | change).values()) + (i,) for i, (change, _) in enumerate(cases)], schema)
    roster = spark.createDataFrame([("a",), ("b",)], "model string")
    found = {r.n: r.reason for r in votes.gate(df, roster, tokens=True).collect()}
    assert found == {i: want for i, (_, want) in enumerate(cases)}


def test_recompute_and_reset(spark):
    rows = [(i, i, "v", "a", "b", "win", "x", "email.1") for i in range(5)] + [(9, 9, "v", "a", "z", "win", "y", "email.1"), (10, 10, "old", "a", "b", "win", "y", "email.1"), (11, 11, "v", "b", "a", "both", None, "other")]
    log = spark.createDataFrame(rows, "seq long, t long, mode string, w string, l string, o string, iph string, scenario string")
    made = votes.recompute(log, spark.createDataFrame([("a",), ("b",)], "model string"), "v", cap=3)
    assert tuple(made["counts"].first()) == (4, 4)
    elo, games = votes.rate([("a", "b", "win")] * 3 + [("b", "a", "both")])
    assert {r.model: (r.elo, r.games) for r in made["main"].collect()} == {m: (elo[m], games[m]) for m in elo}
    assert {(r.domain, r.model, r.games) for r in made["domains"].collect()} == {("email", "a", 3), ("email", "b", 3)}
    tables = {"ratings": log, "tally": log, "scenario_votes": log, "log": log, "domains": log}
    assert {k: v.count() for k, v in votes.reset(tables).items()} == {"ratings": 0, "tally": 0, "scenario_votes": 0, "log": 8, "domains": 8}
    assert votes.reset(tables, wipe=True)["log"].count() == 0


def test_browser(spark):
    df = spark.createDataFrame([("x" * 90,), ("",), (None,)], "fp string")
    assert [r[0] for r in df.select(votes.browser(F.col("fp"))).collect()] == ["x" * 80, "nofp", "nofp"]


def test_samples_are_seeded(spark):
    df = spark.range(5000).withColumnRenamed("id", "position").repartition(3)
    import hashlib

    order = sorted(range(5000), key=lambda i: (hashlib.md5(f"20260114:{i}".encode()).hexdigest(), i))
    assert [r.position for r in resample.sample_by_hash(df, 40, "position").collect()] == sorted(order[:40])
    places = list(range(5000))
    random.Random(20260114).shuffle(places)
    assert [r.position for r in resample.sample_exact(df, 25, "position").collect()] == sorted(places[:25])
    assert resample.sample_exact(df, 6000, "position").count() == 5000


def test_packed_votes_rate_as_votes_one_by_one(spark):
    draw = random.Random(5)
    rows = [(f"b{i % 3}" if i % 50 else None, draw.randrange(40), i, f"m{draw.randrange(300)}", f"m{draw.randrange(300)}", draw.choice(["win", "both", None])) for i in range(20_000)]
    df = spark.createDataFrame(rows, "mode string, t long, seq long, w string, l string, o string")
    want = set()
    for board in {r[0] for r in rows}:
        elo, games = votes.rate([r[3:] for r in sorted((r for r in rows if r[0] == board), key=lambda r: r[1:3])])
        want |= {(board, m, x, games[m]) for m, x in elo.items()}
    assert {tuple(r) for r in votes.elo(df).collect()} == want
    packs = votes.packed(df, "mode")
    # what the one task of a board sorts is a row for thousands of votes, not one for each
    assert packs.count() < 40 and packs.where(f"length(ties) > {votes.PACK}").count() == 0


def test_least_hashes_of_many_sets_at_once():
    draw = random.Random(2)
    found = [dedup.hashed([str(draw.random()) for _ in range(n)]) for n in (1, 7, 300, 1, 2)]
    own = dedup.coefficients()
    want = [[min((a * int(x) + b) % dedup.PRIME % dedup.PRIME for x in h) for a, b in own] for h in found]
    assert dedup.least_hashes(found, own).tolist() == want


def test_interval_draws_are_those_of_python_and_fast():
    import time

    draw = random.Random(3)
    for n in (2, 7, 1000):
        values = [draw.random() * 9 for _ in range(n)]
        own = random.Random(7)
        means = sorted(sum(own.choices(values, k=n)) / n for _ in range(200))
        assert resample.interval_of_mean(values, 200) == (sum(values) / n, means[5], means[195])
    assert resample.interval_of_mean([0.1] * 777, 50) == (0.1, 0.1, 0.1)
    start = time.process_time()
    resample.interval_of_mean([draw.random() for _ in range(200_000)], 50)
    assert time.process_time() - start < 2  # 4 and more with a Python object a draw


def test_interval_groups_arent_put_into_few_tasks(spark):
    df = spark.createDataFrame([(f"m{i % 9}", i, float(i)) for i in range(90)], "model string, place int, value double")
    found = resample.intervals(df, "model", "value", ["place"], 10)
    assert found.rdd.getNumPartitions() >= 8 and found.count() == 9


def test_intervals_of_means(spark):
    draw = random.Random(1)
    rows = [("a" if i % 3 else "b", i, draw.random()) for i in range(60)] + [("c", 99, 0.5), ("d", 100, None)]
    df = spark.createDataFrame(rows, "model string, place int, value double").repartition(4)
    found = {r.model: (r.mean, r.lo, r.hi) for r in resample.intervals(df, "model", "value", ["place"]).collect()}
    assert set(found) == {"a", "b", "c"} and found["c"] == (None, None, None)
    for m in "ab":
        own, seeded = [v for k, _, v in rows if k == m], random.Random(7)
        means = sorted(sum(seeded.choices(own, k=len(own))) / len(own) for _ in range(2000))
        assert found[m] == (pytest.approx(sum(own) / len(own)), means[50], means[1950])


def test_gate_tells_models_apart(spark):
    rows = []
    for i in range(40):
        likely = 0.9 if i % 2 else 0.1
        rows.append((f"m{i % 2}", "email", f"email.{i % 4}", f"{'one two three four five six ' * 3}. Word {i}.", 5, i, (likely, [likely, None])))
    schema = "model string, domain string, scenario string, text string, band_hi int, place int, pangram struct<ai_likelihood: double, window_scores: array<double>>"
    df = spark.createDataFrame(rows, schema)
    for f in reports.DETECTOR_FIELDS[1:]:
        df = df.withColumn("pangram", F.col("pangram").withField(f, F.lit(0.5)))
    found = {(r.kind, r.metric): r for r in reports.go_no_go(df, 200).collect()}
    assert {r.verdict for r in found.values()} == {"go"}
    r = found["detector", "ai_likelihood"]
    assert (r.lowest, r.highest, r.apart) == ("m0", "m1", True) and not found["detector", "fraction_ai"].apart
    assert found["detector", "min_window"].apart and not found["mechanical", "words"].apart
    assert ("mechanical", "length inflation (email)") in found and ("mechanical", "opener repetition") in found
    assert {r.verdict for r in reports.go_no_go(df.drop("pangram"), 200).collect()} == {"incomplete"}
    flat = df.withColumn("pangram", F.col("pangram").withField("ai_likelihood", F.lit(0.2)).withField("window_scores", F.array(F.lit(0.2))))
    assert {r.verdict for r in reports.go_no_go(flat, 200).collect()} == {"no-go"}
    corr = {r.field: (r.r, r.artifact) for r in reports.length_correlations(df.withColumn("pangram", F.col("pangram").withField("fraction_ai", F.length("text").cast("double")))).collect()}
    assert corr["fraction_human"] == (None, False)


def test_synthesis_and_lexical_comparison(spark):

    verdicts = spark.createDataFrame([("email", "delve", "validated"), ("slack", "delve", "validated"), ("slack", "signoff", "busted")], "domain string, tell string, verdict string")
    bands = spark.createDataFrame([("email", True, False, False), ("slack", False, False, False)], "domain string, floor_too_low boolean, ceiling_too_high boolean, ceiling_too_low boolean")
    models = spark.createDataFrame([("email", "m", 50.0, 1.0), ("email", "n", 40.0, 3.0), ("slack", "m", 50.0, None)], "domain string, model string, mtld double, para_spread double")
    human = spark.createDataFrame([("email", 45.0, 2.0), ("slack", 20.0, None)], "domain string, human_mtld double, human_spread double")
    lexical = reports.lexical_comparison(models, human)
    assert {(r.domain, r.models, r.above_mtld, r.spread_models, r.below_spread) for r in lexical.collect()} == {("email", 2, 1, 2, 1), ("slack", 1, 1, 0, 0)}
    found = {(r.section, r.domain, r.finding): r.value for r in reports.synthesis(verdicts, bands, lexical).collect()}
    assert found == {
        ("tells", "email", "validated"): "delve", ("tells", "slack", "validated"): "delve", ("tells", "slack", "busted"): "signoff", ("tells", None, "validated in all"): "delve",
        ("bands", "email", "flags"): "floor_too_low", ("bands", "slack", "flags"): "consistent",
        ("diversity", "email", "models above people"): "some", ("diversity", "slack", "models above people"): "all",
        ("flattening", "email", "models below people"): "1/2", ("flattening", "slack", "models below people"): "unknown",
    }


def test_names_prices_and_costs(spark):
    bench = spark.createDataFrame([("a", 3.0, 10.0), ("b", 9.0, None), ("c", 5.0, 2.0), ("d", None, 3.0)], "model string, score double, blended double")
    assert tuple(reports.highlights(bench).first()) == ("b", "a", "a", "c")
    named = reports.with_names(bench, spark.createDataFrame([("a", "A", "Lab")], "model string, name string, lab string")).orderBy("model").collect()
    assert [(r.name, r.lab) for r in named] == [("A", "Lab"), ("b", ""), ("c", ""), ("d", "")]
    assert {r.model: r.x for r in reports.price_axis(bench).collect()}["a"] == 1.0
    assert spark.range(1).select(reports.manual_cost(F.lit(1000), F.lit(500), F.lit(2.0), F.lit(10.0))).first()[0] == pytest.approx(0.007)


def test_benchmark_items_of_any_length_are_found(spark):
    docs = spark.createDataFrame([(1, "a short ONE, here"), (2, "x" * 600 + " the long item that stands past the first part of a text"), (3, None), (4, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(10, "one"), (11, "The long item that stands past the first part"), (12, "!!"), (13, None), (14, "x" * 30)], "item_id long, text string")
    assert {r.doc_id: r["items"] for r in reports.contained(docs, items).collect()} == {1: 1, 2: 2, 4: 1}
    assert reports.contained(docs, items.limit(0)).count() == 0


def test_empty_cells_of_the_inflation_matrix_are_zero(spark):
    rows = spark.createDataFrame([("m", "email", 0.5), ("m", "email", None), ("n", "slack", None)], "model string, domain string, inflation double")
    found = {r.model: (r.email, r.essay, r.slack, r.social, r.overall) for r in reports.inflation_matrix(rows).collect()}
    assert found == {"m": (0.5, 0, 0, 0, 0.5), "n": (0, 0, 0, 0, 0)}


def test_votes_without_address_share_one(spark):
    rows = [(i, i, "v", "a", "b", "win", None) for i in range(4)]
    log = spark.createDataFrame(rows, "seq long, t long, mode string, w string, l string, o string, iph string")
    roster = spark.createDataFrame([("a",), ("b",)], "model string")
    assert [r.used for r in votes.recomputed(log, roster, "v", 2).orderBy("seq").collect()] == [True, True, False, False]
    assert votes.recomputed(log, roster, "v", 0).where("used").count() == 4


def test_domain_scores_are_absolute_and_the_overall_one_is_relative(spark):
    bench = spark.createDataFrame([("a", 30.0, 40.0, None, 120.0), ("b", 10.0, 40.0, 5.0, 0.0)], "model string, email double, essay double, slack double, social double")
    none = spark.createDataFrame([], "domain string, model string, elo long")
    found = {(r.model, r.domain): r.score for r in votes.domain_human_score(bench, none).collect()}
    assert found["a", "email"] == pytest.approx(20 + 0.6 * 70) and found["b", "email"] == pytest.approx(20 + 0.6 * 90)
    assert found["a", "essay"] == found["b", "essay"] and found["a", "social"] == pytest.approx(20)
    axes = spark.createDataFrame([("a", 10.0, 1.0, 1.0, 1.0), ("b", 20.0, 1.0, 1.0, 1.0)], "model string, conciseness double, templating double, rhythm double, tells double")
    scores = {r.model: r.score for r in votes.human_score(axes, spark.createDataFrame([("a", 1600)], "model string, elo long")).collect()}
    assert scores == {"a": pytest.approx(20 + 15), "b": pytest.approx(20)}


def test_repetition_of_the_gate_counts_single_texts(spark):
    rows = [("m", "email", "email.1", "same words here now again", 9, 1), ("m", "email", "email.2", "same words here now again x", 9, 2), ("m", "email", "email.2", "other words here now again", 9, 3)]
    df = spark.createDataFrame(rows, "model string, domain string, scenario string, text string, band_hi int, place int")
    found = sorted(r.value for r in reports.gate_measures(df).where("metric = 'opener repetition'").collect())
    assert found == [0.5, 1.0]
