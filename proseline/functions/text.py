"""Text measures as native columns: tokens, openers, sentences, paragraphs, tells, dashes, intents, spread."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A token: letters, numbers, underscores and apostrophes, without apostrophes at its ends. Java and RE2 read it alike.
TOKEN = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_']*[\p{L}\p{N}_])?"
#: White space as Unicode has it, with the information separators.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"

# Phrases that count as tells, by name.
TELLS = {
    "finds_you_well": r"hope (this|the) (email|message) finds you",
    "reach_out": r"\b(reach(ing)? out|reached out)\b",
    "circle_back": r"\b(circl(e|ing) back|touch base|following up on my)\b",
    "not_just_but": r"\bnot just [^.,;]{1,40},? but\b|\bit'?s not (just )?about [^.,;]{1,40}[,;] it'?s\b",
    "delve": r"\bdelv(e|ing|ed)\b",
    "tapestry_testament": r"\b(tapestry|testament to|underscore(s|d)?|pivotal)\b",
    "thrilled_excited": r"\b(thrilled|excited|delighted) to (announce|share)\b",
    "elevate_seamless": r"\b(elevate|seamless|streamline|leverage|robust|game[- ]chang)\w*\b",
    "dont_hesitate": r"don'?t hesitate",
    "let_that_sink": r"\b(let that sink in|read that again|agree\?)\b",
    "signoff": r"\b(best regards|kind regards|warm regards|sincerely|best,)\b",
    "greeting": r"^\s*(hi|hello|hey|dear)\b[^\n]{0,30}[,!]",
    "em_dash": r"—",
    "any_dash": r"—|–|(?<!-)--(?!-)|\s-\s",
    "rule_of_three": r"\b\w+ing\b,\s+\b\w+ing\b,?\s+and\s+\b\w+ing\b",
    "as_an_ai": r"\bas an ai\b",
    "apology": r"\b(i apologize|sorry for|apologies for|my apologies)\b",
}
# Dashes by form.
DASHES = {
    "em_dash": r"—",
    "en_dash": r"–",
    "ascii_double_dash": r"(?<!-)--(?!-)",
    "spaced_hyphen": r"\s-\s",
    "any_dash": r"—|–|(?<!-)--(?!-)|\s-\s",
}
# Intents of an email, the first that matches counts; thanks looks at the first line and comes first.
INTENTS = {
    "thanks": r"^\s*(thank you|thanks)\b",
    "scheduling": (
        r"\b(meeting|schedule|calendar|conference call|available|call at|"
        r"monday|tuesday|wednesday|thursday|friday|a\.?m\.?|p\.?m\.?)\b"
    ),
    "decline_negative": r"\b(unfortunately|can'?t|cannot|won'?t be able|not able to|no longer)\b",
    "request": r"\?\s*$|\b(could you|can you|would you|please (let me know|advise|send))\b",
    "update_fyi": r"\b(attached|fyi|please find|per your request|as discussed|update)\b",
}
#: Flags that make Java's patterns fold case by Unicode and break lines at \n only.
FLAGS = "(?iud)"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("bigint")


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that it names several times: as a lambda's variable it is found once."""
    return F.transform(F.array(value), f)[0]


def opener(text: Column, n: int = 5) -> Column:
    """The first n tokens in lower case. The text is read up to the nth token only."""
    head = F.regexp_extract(text, rf"^(?:[^\p{{L}}\p{{N}}_]*{TOKEN}){{1,{n}}}", 0)
    return F.lower(F.array_join(tokens(head), " "))


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, f"^{SPACE}+", ""), f"{SPACE}+$", "")


def sentence_lengths(text: Column) -> Column:
    """Tokens of each sentence; a sentence ends at . ! or ? before white space."""
    parts = F.split(stripped(text), rf"(?<=[.!?]){SPACE}+")
    return F.transform(F.filter(parts, lambda x: F.regexp_like(x, F.lit(r"\S"))), n_tokens)


def paragraph_lengths(text: Column) -> Column:
    """Tokens of each paragraph; paragraphs are parted by two line breaks."""
    return F.transform(F.filter(F.split(text, "\n\n"), lambda x: F.regexp_like(x, F.lit(r"\S"))), n_tokens)


def spread(values: Column) -> Column:
    """Population standard deviation of an array; null for fewer than two values."""

    def of(x: Column) -> Column:
        n, zero = F.size(x), F.lit(0).cast("bigint")
        sums = F.aggregate(
            x, F.struct(zero.alias("total"), zero.alias("squares")),
            lambda a, v: F.struct((a["total"] + v).alias("total"), (a["squares"] + v * v).alias("squares")),
        )
        # in whole numbers up to the division, so that equal lengths have no spread at all
        return once(sums, lambda a: F.when(n > 1, F.sqrt((a["squares"] * n - a["total"] * a["total"]).cast("double")) / n))

    return once(values, of)


def burstiness(text: Column) -> Column:
    return spread(sentence_lengths(text))


def paragraph_spread(text: Column) -> Column:
    return spread(paragraph_lengths(text))


def hits(text: Column, pattern: str, multiline: bool = True) -> Column:
    return F.regexp_count(text, F.lit(("(?m)" if multiline else "") + FLAGS + pattern)).cast("bigint")


#: What a text must have somewhere, case folded, for a pattern to be found at all; patterns that aren't here always run.
NEEDED = {
    "finds_you_well": ("finds you",),
    "reach_out": ("reach",),
    "circle_back": ("circl", "touch base", "following up on my"),
    "not_just_but": ("not just ", "s not "),
    "delve": ("delv",),
    "tapestry_testament": ("tapestry", "testament to", "underscore", "pivotal"),
    "thrilled_excited": ("ed to ",),
    "elevate_seamless": ("elevate", "seamless", "streamline", "leverage", "robust", "chang"),
    "dont_hesitate": ("t hesitate",),
    "let_that_sink": ("let that sink in", "read that again", "agree?"),
    "signoff": ("regards", "sincerely", "best,"),
    "em_dash": ("—",),
    "en_dash": ("–",),
    "ascii_double_dash": ("--",),
    "spaced_hyphen": ("-",),
    "any_dash": ("—", "–", "-"),
    "rule_of_three": ("ing,",),
    "as_an_ai": ("as an ai",),
    "apology": ("i apologize", "sorry for", "apologies"),
}


def folded(text: Column) -> Column:
    """Lower case, with the letters that patterns which ignore case take for s, i and k as these."""
    return F.lower(F.translate(text, "ſİıK", "siik"))


def _guarded(text: Column, patterns: dict[str, str], multiline: bool) -> dict[str, Column]:
    """Hits of each pattern. Most texts have few of the phrases, and a plain search for their letters is far cheaper than a
    pattern that ignores case; the folded text is made once for all patterns."""

    def of(low: Column) -> Column:
        counts = []
        for name, pattern in patterns.items():
            found = hits(text, pattern, multiline)
            if needed := NEEDED.get(name):
                may = reduce(lambda a, b: a | b, [F.contains(low, F.lit(x)) for x in needed])
                found = F.when(text.isNull(), None).when(may, found).otherwise(F.lit(0).cast("bigint"))
            counts.append(found.alias(name))
        return F.struct(*counts)

    found = once(folded(text), of)
    return {name: found[name] for name in patterns}


def tell_hits(text: Column) -> dict[str, Column]:
    return _guarded(text, TELLS, True)


def dash_hits(text: Column) -> dict[str, Column]:
    return _guarded(text, DASHES, False)


def intent(text: Column) -> Column:
    first = F.split(stripped(text), r"[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]", 2)[0]
    found = F.when(F.regexp_like(first, F.lit(FLAGS + INTENTS["thanks"])), "thanks")
    for name, pattern in INTENTS.items():
        if name != "thanks":
            found = found.when(F.regexp_like(text, F.lit(FLAGS + pattern)), name)
    return found.otherwise("other")


def family(model: Column) -> Column:
    """The family of a model by the beginning of its name, else the name."""
    found = None
    for name in ("gpt", "gemini", "claude", "deepseek", "kimi"):
        test = model.startswith(name)
        found = F.when(test, name) if found is None else found.when(test, name)
    return found.otherwise(model)


def normalised(text: Column) -> Column:
    """Lower case without anything but a-z, 0-9 and spaces; runs of spaces are one. Line breaks vanish."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9 ]", ""), " +", " "))


def normalised_hash(text: Column) -> Column:
    return F.sha1(normalised(text))


def shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k lower-case tokens; all tokens if there are fewer."""

    def of(words: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(words) - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))
        return F.when(F.size(words) < k, F.array(F.array_join(words, " "))).otherwise(F.array_distinct(runs))

    # as a lambda's variable the tokens are found once, not once for each run
    return F.transform(F.array(F.split(F.lower(F.array_join(tokens(text), " ")), " ")), of)[0]


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def scale(value: Column, human: Column, ceiling: float = 3.0) -> Column:
    """0 at the human rate or below, 100 at ceiling times it; null without a human rate above 0."""
    ratio = value / F.when(human > 0, human)
    return F.when(ratio <= 1, 0.0).when(ratio > 1, F.least(F.lit(100.0), 100 * (ratio - 1) / (ceiling - 1)))


def domain_of(scenario: Column) -> Column:
    first = F.substring_index(scenario, ".", 1)
    return F.when(first.isin("email", "slack", "essay", "social"), first)


def mode(name: Column, default: str = "reply") -> Column:
    """A board's name: what isn't a-z is dropped; where nothing is left or given, the default."""
    return F.coalesce(F.nullif(F.regexp_replace(name, "[^a-z]", ""), F.lit("")), F.lit(default))


def browser_hash(signature: Column) -> Column:
    """A signature's 32-bit hash, 31 h + c over its UTF-16 units, in base 36."""
    units = F.filter(F.transform(F.split(F.hex(F.encode(signature, "UTF-16BE")), "(?<=\\G.{4})"), lambda x: F.conv(x, 16, 10).cast("bigint")), lambda x: x.isNotNull())
    total = F.aggregate(units, F.lit(0).cast("bigint"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))
    return F.lower(F.conv(total.cast("string"), 10, 36))


def mini_markdown(text: Column) -> Column:
    """HTML of a text: & < > escaped, **bold**, *italic* and `code` marked up; a null text is empty."""
    out = F.coalesce(text, F.lit(""))
    for plain, reference in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(plain), F.lit(reference))
    out = F.regexp_replace(out, r"\*\*([^*]+)\*\*", "<b>$1</b>")
    out = F.regexp_replace(out, r"(^|[^*])\*([^*\n]+)\*(?!\*)", "$1<i>$2</i>")
    return F.regexp_replace(out, "`([^`]+)`", "<code>$1</code>")


def ago(t: Column, now: Column) -> Column:
    """How long before now (both in milliseconds) t is, in seconds, minutes or hours."""
    half_up = lambda x: F.floor(x + 0.5).cast("bigint")
    seconds = F.greatest(F.lit(0).cast("bigint"), half_up((now - t) / 1000))
    minutes = half_up(seconds / 60)
    label = lambda n, unit: F.concat(n.cast("string"), F.lit(f"{unit} ago"))
    return F.when(seconds < 60, label(seconds, "s")).when(minutes < 60, label(minutes, "m")).otherwise(label(half_up(minutes / 60), "h"))


def flag(country: Column) -> Column:
    """The flag of a two-letter country code as an emoji, a globe for anything else."""
    # a letter's regional indicator is 127397 above it, in UTF-8 F0 9F 87 A6 for A
    letter = lambda i: F.decode(F.unhex(F.concat(F.lit("F09F87"), F.hex(F.ascii(F.substring(country, i, 1)) + 101))), "UTF-8")
    return F.when(F.regexp_like(country, F.lit("^[A-Z]{2}$")), F.concat(letter(1), letter(2))).otherwise("🌐")


def marker_score(rate: Column, median: Column, cap: float = 20.0) -> Column:
    """0 at the human median rate or below, 100 at cap times it, on a logarithmic scale between; null without a median above 0."""
    ratio = rate / F.when(median > 0, median)
    return F.when(ratio <= 1, 0.0).when(ratio > 1, F.least(F.lit(100.0), 100 * F.log(ratio) / math.log(cap)))
