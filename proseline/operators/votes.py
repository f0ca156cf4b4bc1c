"""Pairwise votes: gates, rate limit, flood cap, Elo, boards, tallies, feed.

A vote has seq (its place in the log), t (milliseconds), mode, w and l (models), o (win or both), scenario, fp (browser),
iph (address hash) and, where asked for, dwell and attention.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from proseline.functions import text as T
from proseline.operators.folds import fold

START, STEP = 1500, 32
GAP_MS, DAILY_PAIR, DAILY_ADDRESS = 1500, 400, 800
LEAST_DWELL_MS = 1200
MOST_PAIR_AGE_MS = 30 * 60 * 1000
FLOOD_CAP = 50
#: Votes that are packed into one row for a board's fold, some bytes each.
PACK = 4096


def gate(votes: DataFrame, roster: DataFrame, tokens: bool = False) -> DataFrame:
    """votes with reason: the first gate that turns a vote away, null if none does; no state is needed.

    With tokens, a vote that isn't an attention check needs a session that hasn't ended and the pair that was served, no
    older than MOST_PAIR_AGE_MS, and its dwell is its time since then. Their signatures are checked outside; here a token
    is its columns: session_kind, session_end, pair_kind, pair_a, pair_b (models in order of name) and pair_t.
    """
    known = roster.select(F.col("model").alias("_m"))
    marked = (
        votes.join(F.broadcast(known.withColumn("_w", F.lit(True))), F.col("w") == F.col("_m"), "left").drop("_m")
        .join(F.broadcast(known.withColumn("_l", F.lit(True))), F.col("l") == F.col("_m"), "left").drop("_m")
    )
    attention = F.coalesce(F.col("attention"), F.lit(False))
    reason = F.when(F.col("w").isNull() | F.col("l").isNull() | (F.col("w") == F.col("l")), "bad_fields").when(
        F.col("_w").isNull() | F.col("_l").isNull(), "unknown_model"
    )
    dwell = F.col("dwell")
    if tokens:
        session = (F.col("session_kind") == "sess") & (F.coalesce("session_end", F.lit(0)) >= F.col("t"))
        served = (F.col("pair_a") == F.least("w", "l")) & (F.col("pair_b") == F.greatest("w", "l"))
        age = F.col("t") - F.coalesce("pair_t", F.lit(0))
        pair = (F.col("pair_kind") == "pair") & served & (age <= MOST_PAIR_AGE_MS)
        reason = reason.when(~attention & ~F.coalesce(session, F.lit(False)), "no_session")
        reason = reason.when(~attention & ~F.coalesce(pair, F.lit(False)), "bad_pair")
        dwell = F.when(attention, dwell).otherwise(F.col("t") - F.col("pair_t"))
    reason = (
        reason.when((F.length("fp") > 80) | (F.length("scenario") > 60), "too_long")
        .when(attention, "attention")
        .when(dwell < LEAST_DWELL_MS, "too_fast")
    )
    return marked.withColumn("reason", reason).drop("_w", "_l")


def browser(fp: Column) -> Column:
    """The browser that a vote is told by: 80 characters at most, nofp where none is given."""
    return F.substring(F.coalesce(F.nullif(fp, F.lit("")), F.lit("nofp")), 1, 80)


class Limiter:
    """Rate and daily limits of one address; a vote is told whether it counts, in order of time."""

    def __init__(self, gap: float, per_pair: int, per_address: int):
        self.gap, self.per_pair, self.per_address = gap, per_pair, per_address
        self.last: float | None = None
        self.day: int | None = None
        self.last_of: dict = {}
        self.seen: dict = {}

    def reason(self, t: float, fp: str) -> str | None:
        near = [x for x in (self.last, self.last_of.get(fp)) if x is not None]
        if any(t - x < self.gap for x in near):
            return "rate"
        day = int(t // 86_400_000)
        if day != self.day:
            # what is counted is a day's votes, and a gap is shorter than a day
            self.day, self.seen = day, {k: n for k, n in self.seen.items() if k[0] >= day - 1}
            self.last_of = {k: x for k, x in self.last_of.items() if t - x < self.gap}
        for key in ((day, fp), (day,)):
            self.seen[key] = self.seen.get(key, 0) + 1
        if self.seen[day, fp] > self.per_pair or self.seen[day,] > self.per_address:
            return "daily_cap"
        self.last = self.last_of[fp] = t
        return None


def rate_limit(votes: DataFrame, gap: float = GAP_MS, per_pair: int = DAILY_PAIR, per_address: int = DAILY_ADDRESS) -> DataFrame:
    """seq, iph, fp and reason (rate, daily_cap or null) of each vote.

    The gap counts from the last vote that counted, so it is a fold over each address in order, not a difference of
    neighbours. Votes that come too soon don't count towards the day's cap; those over the cap do. An address's votes
    pass in order; what a task holds is an address's last votes and counts.
    """
    kinds = {f.name: f.dataType.simpleString() for f in votes.schema}
    out = StructType.fromDDL(f"seq {kinds['seq']}, iph {kinds['iph']}, fp {kinds['fp']}, reason string")
    return fold(votes, "iph", ["t", "seq"], ["seq", "t", "fp"], lambda a: Limits(a, Limiter(gap, per_pair, per_address)), out)


class Limits:
    """A limiter over the votes of one address as they come."""

    def __init__(self, address: object, limiter: Limiter):
        self.address, self.limiter = address, limiter

    def add(self, row: tuple) -> list[tuple]:
        seq, t, fp = row
        return [(seq, self.address, fp, self.limiter.reason(t, fp))]

    def end(self) -> tuple:
        return ()


def flood_cap(votes: DataFrame, cap: int = FLOOD_CAP) -> DataFrame:
    """votes with used: whether a vote is among the first `cap` of its address; those without address share one."""
    own = Window.partitionBy("iph").orderBy("t", "seq")
    return votes.withColumn("used", F.row_number().over(own) <= (cap or FLOOD_CAP))


def _rounded(x: float) -> int:
    return math.floor(x + 0.5)


class Ratings:
    """Ratings and games of one board's models, vote by vote; each side's rating is rounded by itself."""

    def __init__(self, board: object = None):
        self.board, self.elo, self.games = board, {}, {}

    def add(self, row: tuple) -> tuple:
        w, l, o = row  # noqa: E741
        a, b = self.elo.get(w, START), self.elo.get(l, START)
        expected = 1 / (1 + 10 ** ((b - a) / 400))
        won = 0.5 if o == "both" else 1.0
        self.elo[w], self.elo[l] = _rounded(a + STEP * (won - expected)), _rounded(b + STEP * ((1 - won) - (1 - expected)))
        self.games[w], self.games[l] = self.games.get(w, 0) + 1, self.games.get(l, 0) + 1
        return ()

    def end(self) -> list[tuple]:
        return [(self.board, model, rating, self.games[model]) for model, rating in self.elo.items()]


def rate(pairs) -> tuple[dict, dict]:
    """Ratings and games of models after (w, l, o) in order."""
    state = Ratings()
    for row in pairs:
        state.add(row)
    return state.elo, state.games


class PackedRatings(Ratings):
    """Ratings after packs of votes, as `packed` makes them."""

    def add(self, row: tuple) -> tuple:
        names, *sides, ties = row
        kind = np.uint8 if len(names) <= 256 else np.uint32
        w, l = (np.frombuffer(x, kind) for x in sides)  # noqa: E741
        ratings, expect = [self.elo.get(n, START) for n in names], {}
        for i, j, tie in zip(w.tolist(), l.tolist(), ties, strict=True):
            a, b = ratings[i], ratings[j]
            expected = expect.get(b - a)
            if expected is None:
                expected = expect[b - a] = 1 / (1 + 10 ** ((b - a) / 400))
            won = 0.5 if tie else 1.0
            ratings[i], ratings[j] = _rounded(a + STEP * (won - expected)), _rounded(b + STEP * ((1 - won) - (1 - expected)))
        played = np.bincount(w, minlength=len(names)) + np.bincount(l[w != l], minlength=len(names))
        for name, rating, n in zip(names, ratings, played.tolist(), strict=True):
            self.elo[name], self.games[name] = rating, self.games.get(name, 0) + n
        return ()


def packed(votes: DataFrame, board: str) -> DataFrame:
    """Each board's votes in order of (t, seq), PACK or fewer in a row, sorted by range in many tasks.

    A row has board, t and seq of its first vote, part and number (its place among rows that begin alike), names of its
    models, and bytes: w and l (places in names, a byte each up to 256 names, else four) and ties.
    """
    kinds = {f.name: f.dataType.simpleString() for f in votes.schema}
    out = f"_board {kinds[board]}, t {kinds['t']}, seq {kinds['seq']}, part int, number int, names array<string>, w binary, l binary, ties binary"
    schema = to_arrow_schema(StructType.fromDDL(out))

    def row(table: pa.Table, number: int) -> pa.RecordBatch:
        both = pa.chunked_array([*table.column(3).chunks, *table.column(4).chunks]).combine_chunks().dictionary_encode("encode")
        codes = both.indices.to_numpy(zero_copy_only=False).astype(np.uint8 if len(both.dictionary) <= 256 else np.uint32)
        ties = pc.fill_null(pc.equal(table.column(5), "both"), False).to_numpy().astype(np.uint8)
        n = table.num_rows
        cells = [*(table.column(i)[0].as_py() for i in range(3)), TaskContext.get().partitionId(), number, both.dictionary.to_pylist()]
        cells += [codes[:n].tobytes(), codes[n:].tobytes(), ties.tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t.type) for x, t in zip(cells, schema, strict=True)], schema=schema)

    def run(batches):
        held, size, number, current = [], 0, 0, None
        for batch in batches:
            ends = pc.run_end_encode(batch.column(0))
            start = 0
            for key, end in zip(ends.values.to_pylist(), ends.run_ends.to_pylist(), strict=True):
                while start < end:
                    if held and (size == PACK or current != (key,)):
                        yield row(pa.Table.from_batches(held), number)
                        held, size, number = [], 0, number + 1
                    part = batch.slice(start, min(end - start, PACK - size))
                    held, size, current, start = [*held, part], size + part.num_rows, (key,), start + part.num_rows
        if held:
            yield row(pa.Table.from_batches(held), number)

    rows = votes.select(F.col(board).alias("_board"), "t", "seq", "w", "l", "o")
    return rows.repartitionByRange("_board", "t", "seq").sortWithinPartitions("_board", "t", "seq").mapInArrow(run, out)


def elo(votes: DataFrame, board: str = "mode") -> DataFrame:
    """board, model, elo and games: a fold over each board's log in order of (t, seq).

    Ratings depend on the order of all votes of a board, so a board's votes pass through one task. They are sorted in many
    tasks before and come to it packed, some bytes a vote; what it holds is a number or two a model. Boards go side by side.
    """
    out = StructType.fromDDL(f"{board} {votes.schema[board].dataType.simpleString()}, model string, elo bigint, games bigint")
    return fold(packed(votes, board), "_board", ["t", "seq", "part", "number"], ["names", "w", "l", "ties"], PackedRatings, out)


def recomputed(votes: DataFrame, roster: DataFrame, mode: str, cap: int = FLOOD_CAP) -> DataFrame:
    """votes of a log with used: of the mode, between models of the roster, and among the first `cap` such of its address.

    Ratings are those of used votes; the others count as dropped.
    """
    known = F.broadcast(roster.select(F.col("model").alias("_m"), F.lit(True).alias("_known")))
    marked = votes
    for side in ("w", "l"):
        marked = marked.join(known, F.col(side) == F.col("_m"), "left").withColumn(f"_{side}", F.col("_known").isNotNull()).drop("_m", "_known")
    valid = F.coalesce(F.col("mode") == mode, F.lit(False)) & F.col("_w") & F.col("_l")
    own = Window.partitionBy("iph", "_valid").orderBy("t", "seq")
    marked = marked.withColumn("_valid", valid).withColumn("used", F.col("_valid") & (F.row_number().over(own) <= (cap or FLOOD_CAP)))
    return marked.drop("_w", "_l", "_valid")


def recompute(votes: DataFrame, roster: DataFrame, mode: str, cap: int = FLOOD_CAP) -> dict[str, DataFrame]:
    """A board made anew from its log: counts (used, dropped), main (ratings) and domains (ratings by domain)."""
    marked = recomputed(votes, roster, mode, cap)
    used = marked.where("used")
    return {
        "counts": marked.agg(F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("dropped")),
        "main": elo(used),
        "domains": elo(with_domain(used).where("domain is not null"), "domain"),
    }


def reset(tables: dict[str, DataFrame], wipe: bool = False) -> dict[str, DataFrame]:
    """A board's tables without their rows: ratings, tally and scenario votes, and with wipe the log too; domains' ratings stay."""
    emptied = {"ratings", "tally", "scenario_votes"} | ({"log"} if wipe else set())
    return {name: df.limit(0) if name in emptied else df for name, df in tables.items()}


def win_tally(votes: DataFrame) -> DataFrame:
    """model, wins and games from the raw log; a tie counts as a win of the first model."""
    sides = votes.select(F.explode(F.array(F.struct(F.col("w").alias("model"), F.lit(1).alias("won")), F.struct(F.col("l").alias("model"), F.lit(0).alias("won")))).alias("s"))
    return sides.groupBy("s.model").agg(F.sum("s.won").alias("wins"), F.count("*").alias("games"))


def leaderboard(ratings: DataFrame, partition: str | None = None) -> DataFrame:
    """ratings with place: highest rating first, ties by name."""
    own = Window.partitionBy(partition) if partition else Window.partitionBy()
    return ratings.withColumn("place", F.row_number().over(own.orderBy(F.desc("elo"), "model")))


def feed(votes: DataFrame, n: int = 18) -> DataFrame:
    """The newest n votes without what could tell who voted."""
    return votes.orderBy(F.desc("t"), F.desc("seq")).limit(n).select("t", "w", "l", "o", "c", "scenario")


def recent(votes: DataFrame, now: Column, tail: int = 400, window_ms: int = 3_600_000) -> DataFrame:
    """last_hour: votes of the last hour among the newest `tail`, so tail at most."""
    newest = votes.orderBy(F.desc("t"), F.desc("seq")).limit(tail)
    return newest.agg(F.coalesce(F.sum((F.col("t") >= now - window_ms).cast("bigint")), F.lit(0)).alias("last_hour"))


def tally(gated: DataFrame) -> DataFrame:
    """(outcome, n) of votes with reason: seen, counted, both (ties), attention and each other reason."""
    outcome = F.coalesce("reason", F.when(F.col("o") == "both", "both").otherwise("counted"))
    reached = ~F.coalesce(F.col("reason").isin("bad_fields", "unknown_model", "too_long", "no_session", "bad_pair"), F.lit(False))
    names = F.array_compact(F.array(outcome, F.when(reached, F.lit("seen"))))
    return gated.select(F.explode(names).alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


def stats(gated: DataFrame, now: Column, window_ms: int = 3_600_000) -> DataFrame:
    """One row: total, decided and ties, the log's length, its last hour, votes seen, and rejections by reason.

    gated are all votes that came, with reason; the log is those without. last_hour looks at the newest 400 of the log.
    """
    log = gated.where("reason is null")
    counts = gated.agg(
        F.count_if(F.col("reason").isNull()).alias("total"),
        F.count_if(F.col("reason").isNull() & (F.col("o") != "both")).alias("decided"),
        F.count_if(F.col("reason").isNull() & (F.col("o") == "both")).alias("ties"),
        F.count_if(F.col("reason").isNull()).alias("log_len"),
        F.count_if(F.col("reason").isNull() | F.col("reason").isin("attention", "too_fast", "rate", "daily_cap")).alias("seen"),
        *[F.count_if(F.col("reason") == r).alias(f"rejected_{r}") for r in ("too_fast", "rate", "daily_cap", "no_session", "bad_pair")],
    )
    return counts.join(F.broadcast(recent(log, now, window_ms=window_ms)))


def human_score(bench: DataFrame, ratings: DataFrame) -> DataFrame:
    """model and score: 40 % the rating between the lowest and highest, 15 % each axis between its highest and lowest.

    Without two rated models or more every rating is 50.
    """
    joined = bench.join(F.broadcast(ratings.select("model", "elo")), "model", "left")
    everyone = Window.partitionBy()
    lo, hi = F.min("elo").over(everyone), F.max("elo").over(everyone)
    rated = F.count("elo").over(everyone)
    human = F.when((rated > 1) & F.col("elo").isNotNull(), 100 * (F.col("elo") - lo) / F.greatest(F.lit(1e-9), hi - lo)).otherwise(50.0)

    def inverted(axis: str) -> Column:
        top, low = F.max(axis).over(everyone), F.min(axis).over(everyone)
        return 100 * (top - F.col(axis)) / F.greatest(F.lit(1e-9), top - low)

    axes = ("conciseness", "templating", "rhythm", "tells")
    score = 0.40 * human + sum((0.15 * inverted(a) for a in axes), F.lit(0.0))
    return joined.select("model", score.alias("score"))


def domain_human_score(bench: DataFrame, ratings: DataFrame) -> DataFrame:
    """model, domain and score: 40 % the domain's rating between its bounds (50 without), 60 % 100 less the domain's score."""
    names = ("email", "essay", "slack", "social")
    long = bench.select("model", F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.col(d).alias("value")) for d in names])).alias("x"))
    long = long.select("model", "x.domain", "x.value")
    joined = long.join(F.broadcast(ratings.select("domain", "model", "elo")), ["domain", "model"], "left")
    own = Window.partitionBy("domain")
    lo, hi, rated = F.min("elo").over(own), F.max("elo").over(own), F.count("elo").over(own)
    human = F.when((rated > 1) & F.col("elo").isNotNull(), 100 * (F.col("elo") - lo) / F.greatest(F.lit(1e-9), hi - lo)).otherwise(50.0)
    plain = F.least(F.lit(100.0), F.greatest(F.lit(0.0), 100 - F.col("value")))
    return joined.select("model", "domain", (0.4 * human + 0.6 * plain).alias("score"))


def scenario_votes(votes: DataFrame) -> DataFrame:
    return votes.groupBy("scenario").agg(F.count("*").alias("votes"))


def domain_votes(ratings: DataFrame) -> DataFrame:
    """Votes of each domain, half its games."""
    return ratings.groupBy("domain").agg(F.floor(F.sum("games") / 2 + 0.5).cast("bigint").alias("votes"))


def with_domain(votes: DataFrame) -> DataFrame:
    return votes.withColumn("domain", T.domain_of(F.col("scenario")))
