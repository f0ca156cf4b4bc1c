import re
import statistics

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from proseline.functions import stats
from proseline.functions import text as T
from proseline.functions.python import lexical_diversity, mtld


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text"))).first()[0]


@pytest.mark.parametrize(
    ("text", "n"), [("'hello' rock 'n' roll don't a''b", 6), ("½ cup ² x₂ naïve café Ⅷ", 7), ("", 0), ("...", 0)]
)
def test_tokens(spark, text, n):
    assert one(spark, text, T.n_tokens) == n == len(re.findall(r"\b[\w']+\b", text))


@pytest.mark.parametrize(
    ("text", "tell", "n"),
    [
        ("Best,\nJo", "signoff", 0), ("Best,Jo", "signoff", 1), ("a - - b", "any_dash", 1), ("a -- b", "any_dash", 1),
        ("a --- b", "any_dash", 0), ("a–b — c", "any_dash", 2), ("x-y", "any_dash", 0), ("let's delve. We delves", "delve", 1),
        ("ſincerely", "signoff", 1), ("x\nHey Jo, hi", "greeting", 1), ("agree? yes", "let_that_sink", 0), ("agree?yes", "let_that_sink", 1),
    ],
)
def test_tells(spark, text, tell, n):
    assert one(spark, text, lambda c: T.tell_hits(c)[tell]) == n


def test_rhythm(spark):
    assert one(spark, "A b c. D e! F? G", T.burstiness) == pytest.approx(0.82915619758885)
    assert one(spark, "a b c\n\nd e\n\nf", T.paragraph_spread) == pytest.approx(0.816496580927726)
    assert one(spark, "a single paragraph", T.paragraph_spread) is None
    assert one(spark, "same two\n\nsame two", T.paragraph_spread) == 0


def test_normalised_hash(spark):
    assert one(spark, "Hello,  World!", T.normalised_hash) == "2aae6c35c94fcfb415dbe95f408b9ce91ee846ed"
    assert one(spark, "joined\nwords", T.normalised) == "joinedwords"


def test_shingles(spark):
    assert one(spark, "A b c", T.shingles) == ["a b c"]
    assert sorted(one(spark, "a b c d e f a b c d e", T.shingles)) == sorted(
        {"a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"}
    )


def test_intent_scale_mode(spark):
    assert one(spark, "thanks!\nmeeting on monday", T.intent) == "thanks"
    assert one(spark, "unfortunately no. Could you?", T.intent) == "decline_negative"
    values = [spark.range(1).select(T.scale(F.lit(float(v)), F.lit(h))).first()[0] for v, h in ((1, 1.0), (2, 1.0), (3, 1.0), (5, 1.0), (5, 0.0), (0, 0.0))]
    assert values == [0, 50, 100, 100, None, None]
    assert one(spark, "v1", T.mode) == "v"
    assert [one(spark, x, T.domain_of) for x in ("email.3", "other.1")] == ["email", None]


@pytest.mark.parametrize(
    ("text", "value"),
    [(" ".join(f"w{i}" for i in range(25)), 25.0), ("a b " * 10, 10 / 3), (" ".join(f"w{i % 7}" for i in range(30)), 10.0), ("a " * 19, None)],
)
def test_lexical_diversity(spark, text, value):
    assert lexical_diversity(text) == (pytest.approx(value) if value else None)
    assert one(spark, text, mtld) == (pytest.approx(value) if value else None)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=1, max_size=30))
def test_percentiles_and_summary(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("g", None), ("empty", None)], "k string, v double")
    found = stats.percentiles(df, "v", ["k"]).collect()
    own, n = sorted(values), len(values)
    assert [r.k for r in found] == ["g"]
    assert [found[0][f"p{int(p * 100)}"] for p in stats.POINTS] == [own[min(int(p * n), n - 1)] for p in stats.POINTS]
    s = stats.summary(df, "v", ["k"]).first()
    assert (s.median, s.q1, s.q3, s.n) == (own[n // 2], own[int(0.25 * n)], own[min(int(0.75 * n), n - 1)], n)
    assert s["mean"] == pytest.approx(statistics.mean(values))


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (None, 1.0)], "x double, y double")
    assert df.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] == pytest.approx(1.0)
    assert df.limit(2).agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None
    flat = spark.createDataFrame([(1.0, float(i)) for i in range(4)], "x double, y double")
    assert flat.agg(stats.pearson(F.col("x"), F.col("y"))).first()[0] is None


def plain_mtld(words, threshold=0.72):
    def one(own):
        factors, seen, n = 0.0, set(), 0
        for w in own:
            seen.add(w)
            n += 1
            if len(seen) / n <= threshold:
                factors, seen, n = factors + 1, set(), 0
        if n:
            factors += (1 - len(seen) / n) / (1 - threshold)
        return len(own) / factors if factors else float(len(own))

    return (one(words) + one(words[::-1])) / 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=600))
def test_lexical_diversity_equals_the_plain_loop(words):
    own = [f"w{x}" for x in words]
    assert lexical_diversity(" ".join(own)) == pytest.approx(plain_mtld(own), rel=1e-12)


def test_opener_reads_five_tokens(spark):
    for text in ("'One' two, three-four FIVE six", "a b", "", "...", "x'y 'z' w__ 3.5 q", "é" * 3 + " " + "A" * 3):
        assert one(spark, text, T.opener) == " ".join(w.lower() for w in re.findall(r"\b[\w']+\b", text)[:5])


def test_guards_miss_no_hit(spark):
    texts = [
        "I HOPE THIS EMAIL FINDS YOU", "Reached Out", "CIRCLING back; touch BASE", "it's not about x, it's", "İt's NOT ABOUT x; ıt's", "\u212aind regards \u017fincerely", "tape\u017ftry",
        "Testament To", "DELIGHTED to Announce", "Game-Changing robust\u017f", "DON'T HE\u017fITATE", "Read That Again", "Hı there,", "planning, building, and shipping", "a \t-\n b -- c", "As An Aı", "I apologıze",
    ]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "text string")
    for hits, patterns, multiline in ((T.tell_hits, T.TELLS, True), (T.dash_hits, T.DASHES, False)):
        for name, column in hits(F.col("text")).items():
            plain = T.hits(F.col("text"), patterns[name], multiline)
            assert df.where(~column.eqNullSafe(plain)).collect() == [], name


def test_small_functions(spark):
    def js_hash(text):
        h = 0
        data = text.encode("utf-16-be")
        for i in range(0, len(data), 2):
            h = (h * 31 + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
        digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
        while h:
            h, d = divmod(h, 36)
            out = digits[d] + out
        return out or "0"

    for text in ("Mozilla/5.0|en-US|1920x1080|-60", "é😀", ""):
        assert one(spark, text, T.browser_hash) == js_hash(text)
    assert one(spark, "**b** *i* `c` <x> & ***", T.mini_markdown) == "<b>b</b> <i>i</i> <code>c</code> &lt;x&gt; &amp; ***"
    assert [one(spark, x, T.flag) for x in ("DE", "de", None, "D")] == ["\U0001f1e9\U0001f1ea", "\U0001f310", "\U0001f310", "\U0001f310"]
    ages = [spark.range(1).select(T.ago(F.lit(t), F.lit(10_000_000))).first()[0] for t in (10_000_001, 9_990_500, 9_940_000, 1_000_000, 0)]
    assert ages == ["0s ago", "10s ago", "1m ago", "3h ago", "3h ago"]
    scores = [spark.range(1).select(T.marker_score(F.lit(r), F.lit(m))).first()[0] for r, m in ((1.0, 2.0), (40.0, 2.0), (100.0, 2.0), (2.0 * 20**0.5, 2.0), (1.0, 0.0))]
    assert scores[:3] == [0.0, 100.0, 100.0] and scores[3] == pytest.approx(50.0) and scores[4] is None
    assert [one(spark, x, T.mode) for x in ("V1", "", None)] == ["reply", "reply", "reply"]


def test_address_hash(spark):
    import base64
    import hashlib
    import hmac

    from proseline.functions.python import address_hash

    want = base64.urlsafe_b64encode(hmac.new(b"salt", b"1.2.3.4", hashlib.sha256).digest()).decode()[:22]
    df = spark.createDataFrame([("1.2.3.4",), (None,)], "a string").select(address_hash("salt")("a"))
    assert [r[0] for r in df.collect()] == [want, None]
