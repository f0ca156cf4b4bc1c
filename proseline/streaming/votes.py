"""Votes as a stream: rate limits in keyed state, then appended log, tallies and boards."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from proseline.operators.votes import DAILY_ADDRESS, DAILY_PAIR, GAP_MS, Limiter

SCHEMA = "seq bigint, t bigint, iph string, fp string, reason string"
STATE = "last double, pairs array<string>, times array<double>, days array<string>, counts array<bigint>"


def _restore(state: GroupState, limiter: Limiter) -> None:
    if state.exists:
        last, pairs, times, days, counts = state.get
        limiter.last = last
        limiter.last_of = dict(zip(pairs, times, strict=True))
        for key, n in zip(days, counts, strict=True):
            day, _, fp = key.partition("|")
            limiter.seen[(int(day), fp) if "|" in key else (int(day),)] = n


def rate_limited(
    votes: DataFrame,
    gap: float = GAP_MS,
    per_pair: int = DAILY_PAIR,
    per_address: int = DAILY_ADDRESS,
    idle_ms: int | None = 24 * 3600 * 1000,
) -> DataFrame:
    """Each vote of a stream (seq, t, iph, fp) with its reason, as the batch fold gives it, in order within micro-batches.

    State is an address's last votes and today's counts; what is older than the gap or the day is dropped with each
    batch, so it doesn't grow with the stream, and an idle address's state ends after idle_ms. Spark looks for timeouts
    in every batch, so a stream that is to end by itself (availableNow) needs idle_ms None.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        limiter = Limiter(gap, per_pair, per_address)
        _restore(state, limiter)
        own = pd.concat(list(batches)).sort_values(["t", "seq"])
        own["reason"] = [limiter.reason(t, fp) for t, fp in zip(own["t"], own["fp"], strict=True)]
        newest = float(own["t"].max())
        today = int(newest // 86_400_000)
        recent = {fp: x for fp, x in limiter.last_of.items() if newest - x < gap}
        counts = {k: n for k, n in limiter.seen.items() if k[0] == today}
        names = ["|".join(map(str, k)) for k in counts]
        state.update((limiter.last, list(recent), [float(x) for x in recent.values()], names, [int(n) for n in counts.values()]))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield own[["seq", "t", "iph", "fp", "reason"]]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout
    return votes.select("seq", "t", "iph", "fp").groupBy("iph").applyInPandasWithState(run, SCHEMA, STATE, "append", timeout)


def append_log(folder: str):
    """A foreachBatch function for gated votes (w, l, scenario and reason): the counting votes to the log, outcomes to the
    tallies, and the votes' models and scenarios to the counters. A batch that is run again overwrites what it wrote before.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.persist()
        counted = batch.where("reason is null")
        tally = batch.groupBy(F.coalesce("reason", F.lit("counted")).alias("outcome")).agg(F.count("*").alias("n"))
        games = counted.select(F.explode(F.array("w", "l")).alias("model")).groupBy("model").agg(F.count("*").alias("games"))
        scenarios = counted.where("scenario is not null").groupBy("scenario").agg(F.count("*").alias("votes"))
        for name, df in (("log", counted), ("tally", tally), ("games", games), ("scenarios", scenarios)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
        batch.unpersist()

    return write


def hourly(votes: DataFrame) -> DataFrame:
    """Votes of each hour as they come, late ones up to ten minutes counted."""
    at = votes.withColumn("at", F.timestamp_millis("t")).withWatermark("at", "10 minutes")
    return at.groupBy(F.window("at", "1 hour")).agg(F.count("*").alias("votes")).select("window.start", "votes")


