"""From texts to scores: row measures, sums by scenario, four axes, composite, board, axis table, weight sensitivity."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from proseline.functions import text as T

# Weights of the axes and the multiple of the human rate that scores 100.
WEIGHTS = {"conciseness": 0.35, "templating": 0.30, "rhythm": 0.20, "tells": 0.15}
CEILING = 3.0
AXES = tuple(WEIGHTS)
#: any_dash would count em_dash's hits again.
SCORED_TELLS = tuple(t for t in T.TELLS if t != "any_dash")


def admitted(outputs: DataFrame) -> DataFrame:
    """Rows with text and without error."""
    ok = F.col("text").isNotNull() & (F.col("text") != "")
    return outputs.where(ok & (F.coalesce(F.col("error"), F.lit("")) == "") if "error" in outputs.columns else ok)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of people's or of models' texts; a row without kind is a model's."""
    return rows.where(F.coalesce(F.col("kind"), F.lit("model")) == kind)


def both_kinds(outputs: DataFrame, human: DataFrame) -> DataFrame:
    """Models' and people's texts in one table, told apart by kind; columns that one side lacks are null there."""
    tagged = [df.drop("kind").withColumn("kind", F.lit(k)) for df, k in ((outputs, "model"), (human, "human"))]
    return tagged[0].unionByName(tagged[1], allowMissingColumns=True)


def row_measures(outputs: DataFrame) -> DataFrame:
    """model, domain, scenario, n_words, inflation (null without a band), opener, para_spread and hits by tell.

    band_hi is the upper end of the length band. Each pattern runs once a row.
    """
    n = T.n_tokens(F.col("text"))
    return outputs.select(
        "model", "domain", "scenario",
        n.alias("n_words"),
        F.when(F.col("band_hi") > 0, F.greatest(F.lit(0.0), n / F.col("band_hi") - 1)).alias("inflation"),
        T.opener(F.col("text")).alias("opener"),
        T.paragraph_spread(F.col("text")).alias("para_spread"),
        *[c.alias(f"hits_{name}") for name, c in T.tell_hits(F.col("text")).items()],
    )


def scenario_sums(measures: DataFrame) -> DataFrame:
    """Sufficient statistics of each model, domain and scenario, from which scores and bootstraps are made.

    The opener counts are pre-aggregated, so that two shuffles of ever fewer rows do for all axes.
    """
    keys = ["model", "domain", "scenario"]
    rate = lambda t: 1000 * F.col(f"hits_{t}") / F.greatest(F.col("n_words"), F.lit(1))
    by_opener = measures.groupBy(*keys, "opener").agg(
        F.count("*").alias("n"),
        F.count("inflation").alias("n_band"),
        F.sum("inflation").alias("inflation"),
        F.count("para_spread").alias("n_spread"),
        F.sum("para_spread").alias("spread"),
        F.sum("n_words").alias("n_words"),
        *[F.sum(rate(t)).alias(f"rate_{t}") for t in T.TELLS],
    )
    sums = ("n", "n_band", "inflation", "n_spread", "spread", "n_words", *[f"rate_{t}" for t in T.TELLS])
    return by_opener.groupBy(*keys).agg(F.max("n").alias("most_opener"), *[F.sum(c).alias(c) for c in sums])


def human_profile(human: DataFrame) -> DataFrame:
    """domain, human_spread and human_<tell> (pooled hits for 1000 words) of human texts (domain, text); null without words."""
    n = T.n_tokens(F.col("text"))
    rows = human.select(
        "domain",
        n.alias("n_words"),
        T.paragraph_spread(F.col("text")).alias("spread"),
        *[c.alias(f"hits_{name}") for name, c in T.tell_hits(F.col("text")).items()],
    )
    pooled = lambda t: 1000 * F.sum(f"hits_{t}") / F.nullif(F.sum("n_words"), F.lit(0))
    return rows.groupBy("domain").agg(
        F.avg("spread").alias("human_spread"), *[pooled(t).alias(f"human_{t}") for t in T.TELLS]
    )


def axes(sums: DataFrame, human: DataFrame, by: tuple[str, ...] = ("model", "domain"), times: Column | None = None) -> DataFrame:
    """The four axes of each group of `by`; null where one can't be measured. A domain without human profile keeps its rows.

    times: how often each scenario is drawn, for bootstraps; once unless given.
    """
    k = F.lit(1) if times is None else times
    n = k * F.col("n")
    ratio = F.when((F.col("n") == 1) & (k > 1), F.lit(1.0)).otherwise(F.col("most_opener") / F.col("n"))
    grouped = sums.groupBy(*by).agg(
        (F.sum(k * F.col("inflation")) / F.nullif(F.sum(k * F.col("n_band")), F.lit(0))).alias("_inflation"),
        F.avg(F.when(n >= 2, ratio)).alias("_repeat"),
        F.avg(n).alias("_size"),
        (F.sum(k * F.col("spread")) / F.nullif(F.sum(k * F.col("n_spread")), F.lit(0))).alias("_spread"),
        *[(F.sum(k * F.col(f"rate_{t}")) / F.sum(n)).alias(f"_rate_{t}") for t in SCORED_TELLS],
    )
    known = grouped.join(F.broadcast(human), "domain", "left")
    scores = [
        F.when((F.col(f"human_{t}") == 0) & (F.col(f"_rate_{t}") > 0), F.lit(50.0)).otherwise(
            T.scale(F.col(f"_rate_{t}"), F.col(f"human_{t}"), CEILING)
        )
        for t in SCORED_TELLS
    ]
    given = F.filter(F.array(*scores), lambda x: x.isNotNull())
    mean = lambda g: F.when(F.size(g) > 0, F.aggregate(g, F.lit(0.0), lambda a, x: a + x) / F.size(g))
    floor = 1 / F.col("_size")
    return known.select(
        *by,
        F.least(F.lit(100.0), 100 * F.col("_inflation")).alias("conciseness"),
        F.when(
            F.col("_repeat").isNotNull(),
            F.when(floor < 1, F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 * (F.col("_repeat") - floor) / (1 - floor)))).otherwise(0.0),
        ).alias("templating"),
        F.when(
            F.col("human_spread") > 0,
            F.least(F.lit(100.0), 100 * F.greatest(F.lit(0.0), 1 - F.col("_spread") / F.col("human_spread"))),
        ).alias("rhythm"),
        T.once(given, mean).alias("tells"),
    )


def composite(weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted mean of the axes that aren't null."""
    part = sum((F.when(F.col(a).isNotNull(), F.lit(w) * F.col(a)).otherwise(0.0) for a, w in weights.items()), F.lit(0.0))
    whole = sum((F.when(F.col(a).isNotNull(), F.lit(w)).otherwise(0.0) for a, w in weights.items()), F.lit(0.0))
    return F.when(whole > 0, part / whole)


def board(scores: DataFrame) -> DataFrame:
    """place, model, overall (mean composite over domains) and one column a domain, highest first, ties by name."""
    own = scores.withColumn("composite", composite())
    cell = lambda d: F.max(F.when(F.col("domain") == d, F.col("composite"))).alias(d)
    found = own.groupBy("model").agg(F.avg("composite").alias("overall"), *[cell(d) for d in ("email", "essay", "slack", "social")])
    return found.where("overall is not null").withColumn("place", F.row_number().over(Window.orderBy(F.desc("overall"), "model")))


def axis_table(scores: DataFrame) -> DataFrame:
    """Mean of each axis over the domains that have it, by model."""
    return scores.groupBy("model").agg(*[F.avg(a).alias(a) for a in AXES])


def weight_rows(trials: int = 500, seed: int = 13) -> list[tuple[int, str, float]]:
    """(trial, axis, weight): weights drawn from 0.10 to 0.45 in the order of the axes, made to sum to 1."""
    draw, rows = random.Random(seed), []
    for trial in range(trials):
        own = [draw.uniform(0.10, 0.45) for _ in AXES]
        rows += [(trial, a, w / sum(own)) for a, w in zip(AXES, own, strict=True)]
    return rows


def weight_trials(spark: SparkSession, trials: int = 500, seed: int = 13) -> DataFrame:
    """weight_rows as a table."""
    return spark.createDataFrame(weight_rows(trials, seed), "trial int, axis string, weight double")


def sensitivity(scores: DataFrame, trials: DataFrame) -> DataFrame:
    """trial, model, score and place: each model's weighted mean over all its domains' axes, by trial."""
    cells = scores.select("model", "domain", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("value")) for a in AXES])).alias("c"))
    cells = cells.select("model", "c.axis", "c.value").where("value is not null").groupBy("model", "axis").agg(
        F.sum("value").alias("total"), F.count("*").alias("n")
    )
    found = cells.join(F.broadcast(trials), "axis").groupBy("trial", "model").agg(
        (F.sum(F.col("weight") * F.col("total")) / F.sum(F.col("weight") * F.col("n"))).alias("score")
    )
    return found.withColumn("place", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score"), "model")))


def stability(trials: DataFrame, standing: DataFrame) -> DataFrame:
    """One row: share of trials with the standing's exact order, and the models most often first and last with their shares."""
    own = Window.partitionBy("trial")
    joined = trials.join(F.broadcast(standing.select("model", F.col("place").alias("base"))), "model")
    each = joined.withColumn("last", F.max("place").over(own) == F.col("place"))
    by_trial = each.groupBy("trial").agg(
        F.min((F.col("place") == F.col("base")).cast("int")).alias("same"),
        F.max(F.when(F.col("place") == 1, F.col("model"))).alias("top"),
        F.max(F.when(F.col("last"), F.col("model"))).alias("bottom"),
    )
    count = by_trial.agg(F.count("*").alias("n"), F.avg("same").alias("order_kept"))

    def most(column: str) -> DataFrame:
        tally = by_trial.groupBy(column).agg(F.count("*").alias("k"))
        return tally.orderBy(F.desc("k"), column).limit(1).select(column, F.col("k").alias(f"{column}_n"))

    return count.crossJoin(most("top")).crossJoin(most("bottom")).select(
        "order_kept", "top", (F.col("top_n") / F.col("n")).alias("top_share"), "bottom", (F.col("bottom_n") / F.col("n")).alias("bottom_share")
    )
