"""Reports on scores, costs and corpora: score logs, price join, cost rollup, marker validation, synthesis, bands."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from proseline.functions import stats, text as T
from proseline.functions.python import mtld
from proseline.operators import resample
from proseline.sources.folders import cut

NUMBER = r"([0-9]+(?:\.[0-9]+)?)"


def parse_log(lines: DataFrame) -> DataFrame:
    """(n, value) lines of a fixed-width score log -> one row a model: four domains, overall, four axes, rank and spread.

    The table that a line belongs to is that of the last heading above it. A row whose cells aren't all numbers is skipped.
    """
    heading = (
        F.when(F.regexp_like("value", F.lit(r"email\s+essay\s+slack\s+social\s+OVERALL")), "overall")
        .when(F.regexp_like("value", F.lit(r"conciseness\s+templating\s+rhythm\s+tells")), "axes")
        .when(F.regexp_like("value", F.lit(r"^sensitivity")), "none")
        .when(F.regexp_like("value", F.lit(r"rank\s+model\s+\S+\s+spread")), "ranks")
        .when(F.regexp_like("value", F.lit(r"^TIE GROUPS")), "none")
    )
    # a log is a page of text
    placed = lines.withColumn("part", F.last(heading, ignorenulls=True).over(Window.orderBy("n")))
    row = r"^\s*([a-z0-9.\-]+)" + (r"\s+" + NUMBER) * 5 + r"\s*$"
    axis = r"^\s*([a-z0-9.\-]+)" + (r"\s+" + NUMBER) * 4 + r"\s*$"
    rank = rf"^\s*(\d+)\s+([a-z0-9.\-]+)\s+{NUMBER}\s+ranks\s+(\S+)\s*$"
    take = lambda p, i: F.regexp_extract("value", p, i)
    overall = placed.where((F.col("part") == "overall") & F.regexp_like("value", F.lit(row))).select(
        take(row, 1).alias("model"), *[take(row, i + 2).cast("double").alias(c) for i, c in enumerate(("email", "essay", "slack", "social", "overall"))]
    )
    axes = placed.where((F.col("part") == "axes") & F.regexp_like("value", F.lit(axis))).select(
        take(axis, 1).alias("model"), *[take(axis, i + 2).cast("double").alias(c) for i, c in enumerate(("conciseness", "templating", "rhythm", "tells"))]
    )
    ranks = placed.where((F.col("part") == "ranks") & F.regexp_like("value", F.lit(rank))).select(
        take(rank, 2).alias("model"), take(rank, 1).cast("int").alias("rank"), take(rank, 4).alias("spread")
    )
    return overall.join(axes, "model", "left").join(ranks, "model", "left").orderBy(F.coalesce("rank", F.lit(99)), "model")


def with_prices(bench: DataFrame, prices: DataFrame) -> DataFrame:
    """bench with price_in, price_out and blended; null where a price isn't known."""
    return bench.join(F.broadcast(prices), "model", "left").withColumn(
        "blended", F.round((F.col("price_in") + F.col("price_out")) / 2, 2)
    )


def with_names(bench: DataFrame, names: DataFrame) -> DataFrame:
    """bench with each model's name and lab (names: model, name, lab); its own name, and no lab, where it isn't known."""
    joined = bench.join(F.broadcast(names), "model", "left")
    return joined.withColumns({"name": F.coalesce("name", "model"), "lab": F.coalesce("lab", F.lit(""))})


def highlights(scored: DataFrame, cheap: float = 3.0) -> DataFrame:
    """One row of (model, score, blended): the best and the worst model, the priciest, and the best of those up to a price.

    A higher score is better; ties go to the first name. Models without a price are neither priciest nor cheap.
    """
    first = lambda order, when: F.min_by("model", F.when(when, F.struct(order, F.col("model"))))
    low, rated, priced = F.col("score"), F.col("score").isNotNull(), F.col("blended").isNotNull()
    return scored.agg(
        first(-low, rated).alias("best"),
        F.max_by("model", F.when(rated, F.struct(-low, F.col("model")))).alias("worst"),
        first(-F.col("blended"), priced).alias("priciest"),
        first(-low, rated & (F.col("blended") <= cheap)).alias("best_cheap"),
    )


def price_axis(scored: DataFrame) -> DataFrame:
    """model, x and y: the logarithm to ten of the blended price against the score, of models that have a price."""
    return scored.where("blended is not null").select("model", F.log10("blended").alias("x"), F.col("score").alias("y"))


def sorted_distinct(df: DataFrame, *columns: str) -> DataFrame:
    """The distinct values of columns in order, as a report lists its models or domains."""
    return df.select(*columns).distinct().orderBy(*columns)


def manual_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def cost_rollup(usage: DataFrame) -> DataFrame:
    """model (null: all), cost, n, tokens, unknown, estimated, retried, for 1000 texts and 1000 tokens."""
    grouped = usage.rollup("model").agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost"),
        F.count("*").alias("n"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.col("cost_usd").isNull().cast("bigint")).alias("unknown"),
        F.sum(F.coalesce(F.col("cost_estimated"), F.lit(False)).cast("bigint")).alias("estimated"),
        F.sum(F.coalesce(F.col("retried"), F.lit(False)).cast("bigint")).alias("retried"),
    )
    return grouped.withColumns(
        {"per_1k": 1000 * F.col("cost") / F.col("n"), "per_1k_tokens": 1000 * F.col("cost") / F.nullif(F.col("tokens"), F.lit(0))}
    )


def projected_cost(plan: DataFrame, costs: DataFrame, default: float = 0.01) -> DataFrame:
    """plan (model, scenarios, samples) -> model and projected cost; an unmeasured model costs the default."""
    found = plan.join(F.broadcast(costs), "model", "left")
    return found.select("model", (F.coalesce("cost_per_text", F.lit(default)) * F.col("scenarios") * F.col("samples")).alias("projected"))


def budget_guard(runs: DataFrame, cap: float, projected: float) -> DataFrame:
    """One row: spent, remaining, and whether a run of that cost is rejected or warned of (over 80 % of the cap)."""
    spent = F.coalesce(F.sum("cost"), F.lit(0.0))
    return runs.agg(spent.alias("spent")).select(
        "spent",
        (F.lit(cap) - F.col("spent")).alias("remaining"),
        (F.lit(projected) > cap - F.col("spent")).alias("rejected"),
        (F.col("spent") + projected > 0.8 * cap).alias("warned"),
    )


def marker_validation(by_model: DataFrame, human: DataFrame, times: float = 5.0, families: int = 3) -> DataFrame:
    """(domain, model, tell, hits, words) against (domain, tell, human_rate): pooled ratio, families above, and verdict.

    A tell is validated if all models together have it `times` as often as people and so many families do by themselves;
    with the ratio alone it is a candidate. Where people never have it, any hit is above.
    """
    rate = 1000 * F.col("hits") / F.nullif(F.col("words"), F.lit(0))
    joined = by_model.join(F.broadcast(human), ["domain", "tell"])
    above = F.when(F.col("human_rate") > 0, rate >= times * F.col("human_rate")).otherwise(rate > 0)
    found = joined.groupBy("domain", "tell", "human_rate").agg(
        (1000 * F.sum("hits") / F.nullif(F.sum("words"), F.lit(0))).alias("rate"),
        F.count_distinct(F.when(above, T.family(F.col("model")))).alias("families"),
    )
    ratio = F.when(F.col("human_rate") > 0, F.col("rate") / F.col("human_rate")).otherwise(
        F.when(F.col("rate") > 0, F.lit(float("inf"))).otherwise(0.0)
    )
    verdict = (
        F.when((F.col("human_rate") == 0) & (F.col("rate") == 0), "n/a")
        .when(F.col("ratio") < times, "busted")
        .when(F.col("families") >= families, "validated")
        .otherwise("candidate")
    )
    return found.withColumn("ratio", ratio).withColumn("verdict", verdict)


def validated_everywhere(verdicts: DataFrame) -> DataFrame:
    """Tells that are validated in every domain."""
    domains = verdicts.select(F.count_distinct("domain").alias("all"))
    good = verdicts.where("verdict = 'validated'").groupBy("tell").agg(F.count_distinct("domain").alias("n"))
    return good.join(F.broadcast(domains), F.col("n") == F.col("all")).select("tell")


def dash_table(by_model: DataFrame, human: DataFrame) -> DataFrame:
    """(domain, model, form, hits, words) against (domain, form, human_rate): domain, form, human_rate, model and rate.

    Rates are pooled, for 1000 words; verdict says whether the model has the form more often than people, less, or as often.
    """
    pooled = by_model.groupBy("domain", "model", "form").agg((1000 * F.sum("hits") / F.greatest(F.sum("words"), F.lit(1))).alias("rate"))
    found = pooled.join(F.broadcast(human), ["domain", "form"], "left").withColumn("human_rate", F.coalesce("human_rate", F.lit(0.0)))
    verdict = F.when(F.col("rate") > F.col("human_rate"), "above").when(F.col("rate") < F.col("human_rate"), "below").otherwise("equal")
    return found.select("domain", "form", "human_rate", "model", "rate", verdict.alias("verdict"))


def synthesis(verdicts: DataFrame, bands: DataFrame, lexical: DataFrame) -> DataFrame:
    """One report over all domains, as (section, domain, finding, value) rows.

    tells: each domain's validated and busted tells, and (domain null) those validated in all. bands: flags of the hand-set
    lengths, or consistent. diversity: whether all, some or no models score above people. flattening: how many models'
    paragraphs are more even than people's; unknown where people's have no spread.
    """
    tells = verdicts.where("verdict in ('validated', 'busted')").groupBy("domain", "verdict").agg(F.sort_array(F.collect_set("tell")).alias("t"))
    row = lambda section, domain, finding, value: [
        F.lit(section).alias("section"), domain.alias("domain"), finding.alias("finding"), value.alias("value")
    ]
    lists = tells.select(*row("tells", F.col("domain"), F.col("verdict"), F.array_join("t", ", ")))
    everywhere = validated_everywhere(verdicts).agg(F.array_join(F.sort_array(F.collect_set("tell")), ", ").alias("t"))
    common = everywhere.select(*row("tells", F.lit(None).cast("string"), F.lit("validated in all"), F.col("t")))
    flags = [F.when(F.col(c), F.lit(c)) for c in ("floor_too_low", "ceiling_too_high", "ceiling_too_low")]
    named = F.array_join(F.array_compact(F.array(*flags)), ", ")
    lengths = bands.select(*row("bands", F.col("domain"), F.lit("flags"), F.when(named == "", "consistent").otherwise(named)))
    above = F.when(F.col("models") == 0, "none").when(F.col("above_mtld") == F.col("models"), "all").when(F.col("above_mtld") > 0, "some").otherwise("none")
    diversity = lexical.where("human_mtld is not null").select(*row("diversity", F.col("domain"), F.lit("models above people"), above))
    flat = F.when(F.col("human_spread").isNull(), "unknown").otherwise(F.concat_ws("/", F.col("below_spread").cast("string"), F.col("spread_models").cast("string")))
    flattening = lexical.select(*row("flattening", F.col("domain"), F.lit("models below people"), flat))
    return reduce(DataFrame.unionByName, [lists, common, lengths, diversity, flattening])


def band_check(bands: DataFrame, lengths: DataFrame) -> DataFrame:
    """Hand-set bands (domain, lo, hi) against human lengths (domain, p10, p75, p90): ranges and three flags."""
    ranges = bands.groupBy("domain").agg(
        F.min("lo").alias("lo_least"), F.max("lo").alias("lo_most"), F.min("hi").alias("hi_least"), F.max("hi").alias("hi_most")
    )
    return ranges.join(F.broadcast(lengths), "domain").select(
        "domain", "lo_least", "lo_most", "hi_least", "hi_most", "p10", "p75", "p90",
        (F.col("lo_least") < F.col("p10") * 0.5).alias("floor_too_low"),
        (F.col("hi_most") > F.col("p90") * 1.5).alias("ceiling_too_high"),
        (F.col("hi_most") < F.col("p75")).alias("ceiling_too_low"),
    )


def lexical_comparison(models: DataFrame, human: DataFrame) -> DataFrame:
    """(domain, model, mtld, para_spread means) against (domain, human_mtld, human_spread): how many models are above, below."""
    joined = models.join(F.broadcast(human), "domain")
    return joined.groupBy("domain", "human_mtld", "human_spread").agg(
        F.count("mtld").alias("models"),
        F.coalesce(F.sum((F.col("mtld") > F.col("human_mtld")).cast("bigint")), F.lit(0)).alias("above_mtld"),
        F.count("para_spread").alias("spread_models"),
        F.coalesce(F.sum((F.col("para_spread") < F.col("human_spread")).cast("bigint")), F.lit(0)).alias("below_spread"),
    )


def inflation_matrix(measures: DataFrame) -> DataFrame:
    """Mean length inflation by model and domain, and overall; a cell without rows is 0."""
    names = ["email", "essay", "slack", "social"]
    wide = measures.groupBy("model").pivot("domain", names).agg(F.avg("inflation"))
    overall = measures.groupBy("model").agg(F.avg("inflation").alias("overall"))
    return wide.join(overall, "model").select("model", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in [*names, "overall"]])


def detector_summary(scored: DataFrame) -> DataFrame:
    """model, flag_rate (score 0.5 or more), mean and lowest window score, over rows with a score."""
    windows = F.filter("window_scores", lambda x: x.isNotNull())
    return scored.where("score is not null").groupBy("model").agg(
        F.count("*").alias("n"),
        F.avg(F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)).alias("flag_rate"),
        F.avg("score").alias("mean_score"),
        F.avg(F.array_min(windows)).alias("mean_lowest_window"),
    )


def false_positives(human: DataFrame) -> DataFrame:
    """source (human unless given), n and share of human texts that the detector flags."""
    return human.where("score is not null").groupBy(F.coalesce("source", F.lit("human")).alias("source")).agg(
        F.count("*").alias("n"), F.avg(F.when(F.col("score") >= 0.5, 1.0).otherwise(0.0)).alias("flagged")
    )


# Fields of the detector's answer that a gate looks at.
DETECTOR_FIELDS = ("ai_likelihood", "fraction_ai", "fraction_ai_assisted", "fraction_human", "avg_ai_likelihood", "max_ai_likelihood")


def gate_measures(outputs: DataFrame) -> DataFrame:
    """(kind, metric, model, place, value): everything by which a run's models may be told apart, a row a value.

    outputs has model, domain, scenario, text, band_hi, place (the order of rows) and, where a detector answered, pangram.
    kind is detector or mechanical. Repetition has a value a scenario, the other metrics one a text; nulls are left out.
    """
    n = T.n_tokens(F.col("text"))
    inflation = F.when(F.col("band_hi") > 0, F.greatest(F.lit(0.0), n / F.col("band_hi") - 1))
    metric = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("metric"), value.cast("double").alias("value"))
    found = [
        metric("mechanical", F.lit("words"), n),
        metric("mechanical", F.lit("lexical diversity"), mtld(F.col("text"))),
        metric("mechanical", F.lit("burstiness"), T.burstiness(F.col("text"))),
        metric("mechanical", F.lit("paragraph spread"), T.paragraph_spread(F.col("text"))),
        metric("mechanical", F.lit("length inflation (overall)"), inflation),
        metric("mechanical", F.concat(F.lit("length inflation ("), "domain", F.lit(")")), inflation),
    ]
    if "pangram" in outputs.columns:
        windows = F.array_min(F.filter("pangram.window_scores", lambda x: x.isNotNull()))
        likely = F.col("pangram.ai_likelihood")
        found += [metric("detector", F.lit(f), F.col(f"pangram.{f}")) for f in DETECTOR_FIELDS]
        found += [metric("detector", F.lit("min_window"), windows)]
        found += [metric("detector", F.lit("flagged_rate"), F.when(likely.isNotNull(), (likely >= 0.5).cast("double")))]
    each = outputs.select("model", "place", F.explode(F.array(*found)).alias("m")).select("m.kind", "m.metric", "model", "place", "m.value")
    counts = outputs.groupBy("model", "scenario", T.opener(F.col("text")).alias("opener")).agg(F.count("*").alias("k"), F.min("place").alias("place"))
    # a scenario with one text counts as all alike here, unlike in the templating axis
    repeats = counts.groupBy("model", "scenario").agg((F.max("k") / F.sum("k")).alias("value"), F.min("place").alias("place"))
    repeats = repeats.select(F.lit("mechanical").alias("kind"), F.lit("opener repetition").alias("metric"), "model", "place", "value")
    return each.where("value is not null").unionByName(repeats)


def go_no_go(outputs: DataFrame, draws: int = 2000) -> DataFrame:
    """kind, metric, lowest, highest, difference, apart and verdict: whether a run's models can be told apart, and by what.

    A metric's models are apart where the bootstrap intervals of the lowest and highest mean don't meet. The verdict is the
    run's: go if some detector field sets models apart, no-go if none does, incomplete without a detector.
    """
    values = gate_measures(outputs).withColumn("cell", F.concat_ws("\x1f", "kind", "metric", "model"))
    means = resample.intervals(values, "cell", "value", ["place"], draws).withColumn("_key", F.split("cell", "\x1f"))
    named = means.select(F.col("_key")[0].alias("kind"), F.col("_key")[1].alias("metric"), F.col("_key")[2].alias("model"), "mean", "lo", "hi")
    # a row a metric, which the verdict needs too: intervals are drawn once
    found = cut(resample.separation(named.where("mean is not null"), ["kind", "metric"]))
    apart = F.max(F.when(F.col("kind") == "detector", F.coalesce(F.col("apart"), F.lit(False)).cast("int")))
    verdict = found.agg(F.when(apart == 1, "go").when(apart == 0, "no-go").otherwise("incomplete").alias("verdict"))
    return found.join(F.broadcast(verdict))


def length_correlations(outputs: DataFrame, fields: tuple[str, ...] = ("ai_likelihood", "fraction_ai", "fraction_human")) -> DataFrame:
    """(field, r, artifact): how a detector's fields go with the number of words; beyond 0.4 either way it may be length."""
    n = T.n_tokens(F.col("text")).cast("double")
    cells = outputs.select(n.alias("n"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"pangram.{f}").cast("double").alias("v")) for f in fields])).alias("x"))
    found = cells.groupBy("x.field").agg(stats.pearson(F.col("n"), F.col("x.v")).alias("r"))
    return found.withColumn("artifact", F.coalesce(F.abs("r") > 0.4, F.lit(False)))


def corpus_profile(rows: DataFrame, by: list[str]) -> dict[str, DataFrame]:
    """Lengths, tells, dashes, rhythm, spread and intents of a corpus (by, text), a table each, all native."""
    n = T.n_tokens(F.col("text"))
    measured = rows.select(*by, "text", n.alias("n_words"))
    tells = measured.select(*by, "n_words", F.explode(F.array(*[F.struct(F.lit(k).alias("tell"), c.alias("hits")) for k, c in T.tell_hits(F.col("text")).items()])).alias("x")).select(*by, "n_words", "x.*")
    dashes = measured.select(*by, "n_words", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), c.alias("hits")) for k, c in T.dash_hits(F.col("text")).items()])).alias("x")).select(*by, "n_words", "x.*")
    return {
        "lengths": stats.percentiles(measured, "n_words", by),
        "tells": tells.groupBy(*by, "tell").agg(
            F.sum("hits").alias("hits"),
            stats.pooled(F.col("hits"), F.col("n_words")).alias("pooled"),
            F.avg(1000 * F.col("hits") / F.greatest(F.col("n_words"), F.lit(1))).alias("mean_rate"),
            F.avg((F.col("hits") > 0).cast("double")).alias("share"),
        ),
        "dashes": dashes.groupBy(*by, "form").agg(F.sum("hits").alias("hits"), stats.pooled(F.col("hits"), F.col("n_words")).alias("pooled")),
        "rhythm": stats.summary(measured.select(*by, T.burstiness(F.col("text")).alias("burstiness")), "burstiness", by),
        "spread": stats.summary(measured.select(*by, T.paragraph_spread(F.col("text")).alias("spread")), "spread", by),
        "intents": stats.percentiles(measured.withColumn("intent", T.intent(F.col("text"))), "n_words", [*by, "intent"]),
    }


#: Characters by which a benchmark item is looked for, and heads up to which they are broadcast.
HEAD, FEW_HEADS = 20, 1_000_000
#: Characters of a text whose places are looked at together.
PART = 512


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id and items: how many items of a benchmark (item_id, text) a document holds whole, as normalised texts.

    An item is found by its first HEAD characters (all of it, if it is shorter) and then compared whole. Of a document only
    the places whose head some item has are shuffled, where the items' heads are few enough to broadcast; their number is
    counted first. Items without any letter or digit are in no document.
    """
    items = benchmark.select("item_id", T.normalised(F.col("text")).alias("t")).where("t <> ''")
    items = items.withColumns({"size": F.least(F.length("t"), F.lit(HEAD)), "head": F.xxhash64(F.substring("t", 1, HEAD))})
    heads = items.select("head").distinct()
    sizes = sorted(r[0] for r in items.select("size").distinct().collect())  # HEAD at most
    own = docs.where("text is not null").select("doc_id", T.normalised(F.col("text")).alias("d"))
    if not sizes:
        return own.groupBy("doc_id").agg(F.count("*").alias("items")).limit(0)

    def heads_of(part: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(part) - n + 1, F.lit(1)))
        return F.transform(places, lambda i: F.xxhash64(F.substr(part, i, F.lit(n))))

    def starts(d: Column) -> Column:
        # a place in a string is found from its beginning, so long texts are taken in parts that overlap
        at = F.sequence(F.lit(1), F.greatest(F.length(d), F.lit(1)), F.lit(PART))
        parts = F.transform(at, lambda i: F.substr(d, i, F.lit(PART + HEAD - 1)))
        return F.array_distinct(F.flatten(F.transform(parts, lambda x: F.concat(*[heads_of(x, n) for n in sizes]))))

    places = own.select("doc_id", F.explode(T.once(F.col("d"), starts)).alias("head"))
    few = heads.count() <= FEW_HEADS
    near = places.join(F.broadcast(heads) if few else heads, "head", "left_semi")
    found = near.join(items, "head").select("doc_id", "item_id", "t").distinct().join(own, "doc_id")
    return found.where(F.contains("d", "t")).groupBy("doc_id").agg(F.count_distinct("item_id").alias("items"))
