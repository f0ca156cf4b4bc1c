"""Seeded resampling: bootstrap intervals, rank spread over resampled scenarios, tie groups, samples, pairings."""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from proseline.operators import scoring

#: Draws that are looked up at a time.
PART = 1 << 16


def interval_of_mean(values: Sequence[float], draws: int = 2000, seed: int = 7) -> tuple[float | None, float | None, float | None]:
    """Mean and 95 % bootstrap interval of values in their order; Nones for fewer than two.

    The draws are those of random.Random(seed).choices: NumPy's Mersenne twister goes on from its state. Sums are made in
    longer floats, so that their order doesn't show.
    """
    n = len(values)
    if n < 2:
        return None, None, None
    _, state, _ = random.Random(seed).getstate()
    draw = np.random.RandomState()
    draw.set_state(("MT19937", np.array(state[:-1], np.uint32), state[-1]))
    own = np.asarray(values, np.longdouble)

    def total() -> np.longdouble:
        return sum(own[(draw.random_sample(min(PART, n - at)) * n).astype(np.int64)].sum() for at in range(0, n, PART))

    means = sorted(float(total()) / n for _ in range(draws))
    return float(own.sum()) / n, means[int(0.025 * draws)], means[int(0.975 * draws)]


def intervals(df: DataFrame, group: str, value: str, order: list[str], draws: int = 2000) -> DataFrame:
    """group, mean, lo, hi. A group's values are resampled together in their order: what a task holds is one group's numbers.

    Few short rows can be much work here, so the number of tasks is given, and isn't made less by the rows' size.
    """
    kind = df.schema[group].dataType.simpleString()
    out = StructType.fromDDL(f"{group} {kind}, mean double, lo double, hi double")
    schema = to_arrow_schema(out)

    def run(batches):
        held, parts = None, []

        def packed() -> pa.RecordBatch:
            cells = [held[0], *interval_of_mean(np.concatenate(parts), draws)]
            return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(cells, schema, strict=True)], schema=schema)

        for batch in batches:
            keys, numbers = pc.run_end_encode(batch.column(0)), batch.column(1).to_numpy(zero_copy_only=False)
            start = 0
            for key, end in zip(keys.values.to_pylist(), keys.run_ends.to_pylist(), strict=True):
                if held != (key,):
                    if held is not None:
                        yield packed()
                    held, parts = (key,), []
                parts.append(numbers[start:end].copy())
                start = end
        if held is not None:
            yield packed()

    rows = df.where(F.col(value).isNotNull()).select(group, *[c for c in order if c != group], F.col(value).cast("double").alias("_value"))
    dealt = rows.repartition(8 * df.sparkSession.sparkContext.defaultParallelism, group)
    return dealt.sortWithinPartitions(group, *[c for c in order if c != group]).select(group, "_value").mapInArrow(run, out)


def separation(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of each group of `by` (one row without): the models of lowest and highest mean, the difference, and whether their
    intervals are apart."""
    return found.groupBy(*(by or [])).agg(
        F.min_by("model", F.struct("mean", "model")).alias("lowest"),
        F.max_by("model", F.struct("mean", "model")).alias("highest"),
        (F.max("mean") - F.min("mean")).alias("difference"),
        (F.min_by("hi", F.struct("mean", "model")) < F.max_by("lo", F.struct("mean", "model"))).alias("apart"),
    )


def draw_rows(scenarios: dict[str, list[str]], replicates: int = 500, seed: int = 42) -> list[tuple[int, str, str, int]]:
    """(rep, domain, scenario, k): how often each scenario is drawn in each replicate, domains and scenarios in order."""
    draw, rows = random.Random(seed), []
    for rep in range(replicates):
        for domain in sorted(scenarios):
            own = sorted(scenarios[domain])
            for scenario, k in Counter(draw.choice(own) for _ in own).items():
                rows.append((rep, domain, scenario, k))
    return rows


def scenario_draws(spark: SparkSession, scenarios: dict[str, list[str]], replicates: int = 500, seed: int = 42) -> DataFrame:
    """draw_rows as a table."""
    return spark.createDataFrame(draw_rows(scenarios, replicates, seed), "rep int, domain string, scenario string, k int")


def rank_spread(sums: DataFrame, human: DataFrame, draws: DataFrame) -> DataFrame:
    """model, best and worst: the 95 % interval of its rank over replicates (1 is the highest score).

    The replicates' weights meet the sums of scenarios, not the texts; a domain none of whose drawn scenarios a model has
    adds nothing to it.
    """
    drawn = sums.join(F.broadcast(draws), ["domain", "scenario"])
    scores = scoring.axes(drawn, human, ("rep", "model", "domain"), F.col("k"))
    overall = scores.withColumn("c", scoring.composite()).groupBy("rep", "model").agg(F.avg("c").alias("score")).where("score is not null")
    # sums of floats depend on their order in the last digits, which shouldn't decide a place
    ranks = overall.withColumn("place", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc(F.round("score", 9)), "model")))
    own = Window.partitionBy("model").orderBy("place", "rep")
    placed = ranks.withColumns({"_at": F.row_number().over(own) - 1, "_n": F.count("*").over(Window.partitionBy("model"))})
    at = lambda p: F.max(F.when(F.col("_at") == F.floor(F.lit(p) * F.col("_n")), F.col("place")))
    return placed.groupBy("model").agg(at(0.025).alias("best"), at(0.975).alias("worst"))


def tie_groups(spreads: DataFrame) -> DataFrame:
    """spreads (model, place, best, worst) with tie_group: the best model without a group begins one and takes all
    without a group whose intervals overlap its own. A row a model reaches the driver, which is what a board has.
    """
    rows = sorted(spreads.select("model", "place", "best", "worst").collect(), key=lambda r: r.place)
    group: dict[str, int] = {}
    for anchor in rows:
        if anchor.model not in group:
            number = max(group.values(), default=0) + 1
            for r in rows:
                if r.model not in group and r.best <= anchor.worst and anchor.best <= r.worst:
                    group[r.model] = number
    named = spreads.sparkSession.createDataFrame(list(group.items()) or [], "model string, tie_group int")
    return spreads.join(F.broadcast(named), "model")


def sample_by_hash(df: DataFrame, k: int, key: str, seed: int = 20260114) -> DataFrame:
    """k rows by order of a seeded hash of key, in key's order.

    Rows whose hash is so high that k others come before it are left out before anything is sorted: the bound lies ten
    standard deviations and a hundred rows above the kth of evenly spread hashes.
    """
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    n = df.count()
    share = (k + 10 * k**0.5 + 100) / max(n, 1)
    near = df.where(place < f"{int(share * (1 << 32)):08x}") if share < 1 else df
    return near.orderBy(place, key).limit(k).orderBy(key)


def sample_exact(df: DataFrame, k: int, position: str, seed: int = 20260114) -> DataFrame:
    """The k rows that a seeded shuffle of all n places keeps, in order; position counts rows from 0 without gaps."""
    n = df.count()
    if n <= k:
        return df
    places = list(range(n))
    random.Random(seed).shuffle(places)
    kept = df.sparkSession.createDataFrame([(p,) for p in places[:k]], "_kept bigint")
    return df.join(kept, df[position] == F.col("_kept"), "left_semi").orderBy(position)


def numbered(df: DataFrame, prefix: str, order: Column | str) -> DataFrame:
    """df with id: the prefix and the row's number from 1 in six digits or more.

    Rows are counted by range partition, then numbered within it, so no task sees all of them.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(spark.sparkContext.defaultParallelism, order).sortWithinPartitions(order)
    placed = placed.withColumn("_part", F.spark_partition_id())
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    start = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_start"))
    own = Window.partitionBy("_part").orderBy(order)
    number = F.col("_start") + F.row_number().over(own)
    return placed.join(F.broadcast(start), "_part").withColumn("id", F.format_string(f"{prefix}-%06d", number)).drop("_part", "_start")


def pairings(outputs: DataFrame, rounds: int = 3, seed: int = 20260714) -> DataFrame:
    """scenario, round, model_a, model_b, text_a, text_b: in each round a scenario's models are paired at random.

    An odd model sits out; each side's text is one of its samples at random. The order of a seeded hash stands for chance.
    """
    salt = lambda *parts: F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))
    models = outputs.select("scenario", "model").distinct().withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    own = Window.partitionBy("scenario", "round").orderBy(salt("scenario", F.col("round").cast("string"), "model"), "model")
    placed = models.withColumn("_at", F.row_number().over(own) - 1)
    side = placed.withColumns({"_pair": F.floor(F.col("_at") / 2), "_side": F.col("_at") % 2})
    chosen = side.join(outputs, ["scenario", "model"])
    pick = Window.partitionBy("scenario", "round", "model").orderBy(salt(F.col("round").cast("string"), F.col("doc_id").cast("string")), "doc_id")
    chosen = chosen.withColumn("_pick", F.row_number().over(pick)).where("_pick = 1")
    return chosen.groupBy("scenario", "round", "_pair").agg(
        F.max(F.when(F.col("_side") == 0, F.col("model"))).alias("model_a"),
        F.max(F.when(F.col("_side") == 1, F.col("model"))).alias("model_b"),
        F.max(F.when(F.col("_side") == 0, F.col("doc_id"))).alias("doc_a"),
        F.max(F.when(F.col("_side") == 1, F.col("doc_id"))).alias("doc_b"),
    ).where("model_b is not null").drop("_pair")
