"""Queries over votes: gates, limits, Elo, boards, feeds, blended scores, and the same as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.operators import reports, scoring, votes
from proseline.plans import views as V
from proseline.plans.scores import _COMPOSITE, AXES_SQL, _rounded, _scores
from proseline.sources.folders import shared_folder
from proseline.streaming import votes as stream

QUERIES, ORACLES = {}, {}
VOTES = f"WITH RECURSIVE v AS ({V.VOTES_SQL})"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_ROSTER = "(" + ", ".join(f"'m{i}'" for i in range(16)) + ")"
_REASON = f"""CASE WHEN w = l THEN 'bad_fields' WHEN w NOT IN {_ROSTER} OR l NOT IN {_ROSTER} THEN 'unknown_model'
WHEN length(fp) > 80 OR length(scenario) > 60 THEN 'too_long' WHEN attention THEN 'attention' WHEN dwell < 1200 THEN 'too_fast' END"""


@query(f"{VOTES}, g AS (SELECT {_REASON} AS reason FROM v) SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM g GROUP BY 1")
def vote_gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    found = votes.gate(V.votes(spark, sf), V.roster(spark))
    return found.groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"{VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY iph ORDER BY t, seq) AS k FROM v) SELECT iph, count(*) FILTER (WHERE k <= 50) AS used, count(*) FILTER (WHERE k > 50) AS dropped FROM r GROUP BY 1")
def flood_cap(spark: SparkSession, sf: str) -> DataFrame:
    capped = votes.flood_cap(V.votes(spark, sf))
    return capped.groupBy("iph").agg(F.count_if("used").alias("used"), F.count_if(~F.col("used")).alias("dropped"))


# A vote's gap to its browser's last counted vote is never less than that to its address's, so the address alone decides.
@query(
    f"""{VOTES}, k AS (SELECT seq, t, iph, fp, row_number() OVER (PARTITION BY iph ORDER BY t, seq) AS k, CAST(floor(t / 86400000.0) AS BIGINT) AS day FROM v),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, iph, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS fp, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS last,
    CAST(NULL AS BIGINT) AS day, CAST(0 AS BIGINT) AS n, map([]::VARCHAR[], []::BIGINT[]) AS own FROM k GROUP BY iph
  UNION ALL
  SELECT k.k, k.iph, k.seq, k.fp, CASE WHEN x.soon THEN 'rate' WHEN x.own > 20 OR x.n > 100 THEN 'daily_cap' END,
    CASE WHEN x.soon OR x.own > 20 OR x.n > 100 THEN f.last ELSE k.t END, CASE WHEN x.soon THEN f.day ELSE k.day END,
    CASE WHEN x.soon THEN f.n ELSE x.n END,
    CASE WHEN x.soon THEN f.own ELSE map_concat(CASE WHEN f.day = k.day THEN f.own ELSE map([]::VARCHAR[], []::BIGINT[]) END, map([k.fp], [x.own])) END
  FROM f JOIN k ON k.iph = f.iph AND k.k = f.k + 1, LATERAL (SELECT coalesce(k.t - f.last < 1500, false) AS soon,
    CASE WHEN f.day = k.day THEN f.n ELSE 0 END + 1 AS n, CASE WHEN f.day = k.day THEN coalesce(f.own[k.fp], 0) ELSE 0 END + 1 AS own) x)
SELECT seq, iph, fp, reason FROM f WHERE k > 0"""
)
def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """A fold in order of time. Caps are low enough to bite here."""
    return votes.rate_limit(V.votes(spark, sf), per_pair=20, per_address=100)


_ELO = """e AS MATERIALIZED (SELECT seq, w, l, o, row_number() OVER (ORDER BY t, seq) AS k FROM v WHERE {}),
f AS (
  SELECT CAST(0 AS BIGINT) AS k, map([]::VARCHAR[], []::BIGINT[]) AS elo
  UNION ALL
  SELECT e.k, map_concat(f.elo, map([e.w, e.l], [
    CAST(floor(x.a + 32 * (x.s - 1 / (1 + pow(10, (x.b - x.a) / 400))) + 0.5) AS BIGINT),
    CAST(floor(x.b + 32 * ((1 - x.s) - (1 - 1 / (1 + pow(10, (x.b - x.a) / 400)))) + 0.5) AS BIGINT)]))
  FROM f JOIN e ON e.k = f.k + 1, LATERAL (SELECT CAST(coalesce(f.elo[e.w], 1500) AS DOUBLE) AS a, CAST(coalesce(f.elo[e.l], 1500) AS DOUBLE) AS b,
    CASE WHEN e.o = 'both' THEN 0.5 ELSE 1.0 END AS s) x),
z AS MATERIALIZED (SELECT elo FROM f ORDER BY k DESC LIMIT 1), r AS MATERIALIZED (SELECT unnest(map_keys(elo)) AS model, unnest(map_values(elo)) AS elo FROM z),
n AS (SELECT model, count(*) AS games FROM (SELECT w AS model FROM e UNION ALL SELECT l FROM e) GROUP BY 1)"""


@query(f"{VOTES}, {_ELO.format('true')} SELECT 'v' AS mode, model, elo, games FROM r JOIN n USING (model)")
def elo_board(spark: SparkSession, sf: str) -> DataFrame:
    from proseline.functions.text import mode

    return votes.elo(V.votes(spark, sf).withColumn("mode", mode(F.col("mode"))))


#: Ratings of each domain, all domains' folds a vote at a time.
_DOMAIN_ELO = """de AS MATERIALIZED (SELECT domain, w, l, o, row_number() OVER (PARTITION BY domain ORDER BY t, seq) AS k FROM v),
df AS (
  SELECT CAST(0 AS BIGINT) AS k, domain, map([]::VARCHAR[], []::BIGINT[]) AS elo FROM de GROUP BY domain
  UNION ALL
  SELECT e.k, e.domain, map_concat(f.elo, map([e.w, e.l], [
    CAST(floor(x.a + 32 * (x.s - 1 / (1 + pow(10, (x.b - x.a) / 400))) + 0.5) AS BIGINT),
    CAST(floor(x.b + 32 * ((1 - x.s) - (1 - 1 / (1 + pow(10, (x.b - x.a) / 400)))) + 0.5) AS BIGINT)]))
  FROM df f JOIN de e ON e.domain = f.domain AND e.k = f.k + 1, LATERAL (SELECT CAST(coalesce(f.elo[e.w], 1500) AS DOUBLE) AS a,
    CAST(coalesce(f.elo[e.l], 1500) AS DOUBLE) AS b, CASE WHEN e.o = 'both' THEN 0.5 ELSE 1.0 END AS s) x),
dz AS (SELECT domain, arg_max(elo, k) AS elo FROM df GROUP BY 1),
dr AS (SELECT domain, unnest(map_keys(elo)) AS model, unnest(map_values(elo)) AS elo FROM dz),
dn AS (SELECT domain, model, count(*) AS games FROM (SELECT domain, w AS model FROM de UNION ALL SELECT domain, l FROM de) GROUP BY 1, 2)"""


@query(f"{VOTES}, {_DOMAIN_ELO} SELECT domain, model, elo, games FROM dr JOIN dn USING (domain, model)")
def elo_by_domain(spark: SparkSession, sf: str) -> DataFrame:
    return votes.elo(votes.with_domain(V.votes(spark, sf)), "domain")


_VALID = f"""va AS (SELECT *, w IN {_ROSTER} AND l IN {_ROSTER} AS valid FROM v),
k AS (SELECT *, CASE WHEN valid THEN row_number() OVER (PARTITION BY iph, valid ORDER BY t, seq) END AS nth FROM va)"""


@query(
    f"""{VOTES}, {_VALID}, {_ELO.format('true').replace('FROM v WHERE true', 'FROM k WHERE nth <= 50')}
SELECT CAST(row_number() OVER (ORDER BY elo DESC, model) AS INT) AS place, model, elo, games FROM r JOIN n USING (model)"""
)
def leaderboard(spark: SparkSession, sf: str) -> DataFrame:
    """The board recomputed from the log: models of the roster, under the flood cap."""
    made = votes.recompute(V.votes(spark, sf), V.roster(spark), "v1")
    return votes.leaderboard(made["main"]).select("place", "model", "elo", "games")


@query(f"{VOTES}, {_VALID} SELECT count(*) FILTER (WHERE nth <= 50) AS used, count(*) FILTER (WHERE NOT coalesce(nth <= 50, false)) AS dropped FROM k")
def recompute_counts(spark: SparkSession, sf: str) -> DataFrame:
    return votes.recompute(V.votes(spark, sf), V.roster(spark), "v1")["counts"]


_TOKENS = """SELECT *, CASE seq % 11 WHEN 0 THEN 'other' ELSE 'sess' END AS session_kind, t + seq % 7 - 1 AS session_end,
  CASE seq % 13 WHEN 0 THEN NULL ELSE 'pair' END AS pair_kind, CASE WHEN seq % 17 = 0 THEN 'm0' ELSE least(w, l) END AS pair_a, greatest(w, l) AS pair_b,
  t - (seq % 19) * 100000 - seq % 2000 AS pair_t FROM {}"""
_TOKEN_REASON = f"""CASE WHEN w = l THEN 'bad_fields' WHEN w NOT IN {_ROSTER} OR l NOT IN {_ROSTER} THEN 'unknown_model'
WHEN NOT attention AND NOT (session_kind = 'sess' AND session_end >= t) THEN 'no_session'
WHEN NOT attention AND NOT coalesce(pair_kind = 'pair' AND pair_a = least(w, l) AND pair_b = greatest(w, l) AND t - pair_t <= 1800000, false) THEN 'bad_pair'
WHEN length(fp) > 80 OR length(scenario) > 60 THEN 'too_long' WHEN attention THEN 'attention' WHEN t - pair_t < 1200 THEN 'too_fast' END"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    """Votes with made-up tokens: sessions that ended, pairs that are missing, swapped or too old."""
    spark_votes = V.votes(spark, sf)
    return votes.gate(spark_votes.selectExpr(*V._split(_TOKENS.removeprefix("SELECT ").removesuffix(" FROM {}"))), V.roster(spark), tokens=True)


@query(f"{VOTES}, k AS ({_TOKENS.format('v')}), g AS (SELECT {_TOKEN_REASON} AS reason FROM k) SELECT coalesce(reason, 'passed') AS reason, count(*) AS n FROM g GROUP BY 1")
def token_gate_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf).groupBy(F.coalesce("reason", F.lit("passed")).alias("reason")).agg(F.count("*").alias("n"))


_GATED = f"{VOTES}, k AS ({_TOKENS.format('v')}), g AS (SELECT *, {_TOKEN_REASON} AS reason FROM k)"


@query(
    f"""{_GATED}, l AS (SELECT * FROM g WHERE reason IS NULL ORDER BY t DESC, seq DESC LIMIT 400), x AS (SELECT CAST(count(*) AS BIGINT) AS last_hour FROM l WHERE t >= 690000 - 3600)
SELECT count(*) FILTER (WHERE reason IS NULL) AS total, count(*) FILTER (WHERE reason IS NULL AND o <> 'both') AS decided,
count(*) FILTER (WHERE reason IS NULL AND o = 'both') AS ties, count(*) FILTER (WHERE reason IS NULL) AS log_len,
count(*) FILTER (WHERE reason IS NULL OR reason IN ('attention', 'too_fast', 'rate', 'daily_cap')) AS seen,
{', '.join(f"count(*) FILTER (WHERE reason = '{r}') AS rejected_{r}" for r in ('too_fast', 'rate', 'daily_cap', 'no_session', 'bad_pair'))}, any_value(last_hour) AS last_hour FROM g, x"""
)
def vote_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Everything that a page of statistics shows, the hour being a short one of the compressed clock."""
    return votes.stats(_gated(spark, sf), F.lit(690000), window_ms=3600)


@query(
    f"""{_GATED}, t AS (SELECT coalesce(reason, CASE WHEN o = 'both' THEN 'both' ELSE 'counted' END) AS outcome FROM g
UNION ALL SELECT 'seen' FROM g WHERE reason IS NULL OR reason IN ('attention', 'too_fast')) SELECT outcome, count(*) AS n FROM t GROUP BY 1"""
)
def vote_tally(spark: SparkSession, sf: str) -> DataFrame:
    return votes.tally(_gated(spark, sf))


@query(f"{VOTES}, {_DOMAIN_ELO} SELECT domain, CAST(floor(sum(games) / 2 + 0.5) AS BIGINT) AS votes FROM dn GROUP BY 1")
def domain_votes(spark: SparkSession, sf: str) -> DataFrame:
    return votes.domain_votes(votes.elo(votes.with_domain(V.votes(spark, sf)), "domain"))


@query(
    f"""{VOTES} SELECT seq, CASE WHEN s < 60 THEN concat(s, 's ago') WHEN floor(s / 60.0 + 0.5) < 60 THEN concat(CAST(floor(s / 60.0 + 0.5) AS BIGINT), 'm ago')
  ELSE concat(CAST(floor(floor(s / 60.0 + 0.5) / 60 + 0.5) AS BIGINT), 'h ago') END AS ago FROM (
  SELECT seq, greatest(0, CAST(floor((30000000 - t * 40) / 1000.0 + 0.5) AS BIGINT)) AS s FROM v)"""
)
def vote_ages(spark: SparkSession, sf: str) -> DataFrame:
    from proseline.functions.text import ago

    return V.votes(spark, sf).select("seq", ago(F.col("t") * 40, F.lit(30000000)).alias("ago"))


@query(f"{VOTES}, s AS (SELECT w AS model, 1 AS won FROM v UNION ALL SELECT l, 0 FROM v) SELECT model, CAST(sum(won) AS BIGINT) AS wins, count(*) AS games FROM s GROUP BY 1")
def win_rates(spark: SparkSession, sf: str) -> DataFrame:
    return votes.win_tally(V.votes(spark, sf))


@query(f"{VOTES}, n AS (SELECT * FROM v ORDER BY t DESC, seq DESC LIMIT 400) SELECT CAST(sum(CAST(t >= (SELECT max(t) FROM v) - 1000 AS INT)) AS BIGINT) AS last_hour FROM n")
def last_hour_feed(spark: SparkSession, sf: str) -> DataFrame:
    """Votes within a second of the compressed clock, among the newest 400."""
    log = V.votes(spark, sf)
    newest = log.agg(F.max("t").alias("now"))
    return votes.recent(log.crossJoin(F.broadcast(newest)), F.col("now"), window_ms=1000)


@query(f"{VOTES} SELECT t, w, l, o, c, scenario FROM v ORDER BY t DESC, seq DESC LIMIT 18")
def newest_feed(spark: SparkSession, sf: str) -> DataFrame:
    return votes.feed(V.votes(spark, sf))


@query(f"{VOTES} SELECT scenario, count(*) AS votes FROM v GROUP BY 1")
def scenario_votes(spark: SparkSession, sf: str) -> DataFrame:
    return votes.scenario_votes(V.votes(spark, sf))


_BENCH = f"""WITH RECURSIVE v AS ({V.VOTES_SQL}), {AXES_SQL},
cm AS (SELECT model, domain, {_COMPOSITE} AS composite FROM axes),
be AS (SELECT replace(model, 'src', 'm') AS model, avg(conciseness) AS conciseness, avg(templating) AS templating, avg(rhythm) AS rhythm, avg(tells) AS tells FROM axes GROUP BY 1)"""


def _inverted(a: str) -> str:
    return f"0.15 * 100 * (max({a}) OVER () - {a}) / greatest(1e-9, max({a}) OVER () - min({a}) OVER ())"


@query(
    f"""{_BENCH}, {_ELO.format('true')}, x AS (SELECT be.*, elo FROM be LEFT JOIN r USING (model))
SELECT model, round(0.40 * CASE WHEN elo IS NULL THEN 50.0 ELSE 100.0 * (elo - min(elo) OVER ()) / greatest(1e-9, max(elo) OVER () - min(elo) OVER ()) END
+ {' + '.join(map(_inverted, ('conciseness', 'templating', 'rhythm', 'tells')))}, 4) AS score FROM x"""
)
def human_score(spark: SparkSession, sf: str) -> DataFrame:
    bench = scoring.axis_table(_scores(spark, sf)).withColumn("model", F.regexp_replace("model", "src", "m"))
    return _rounded(votes.human_score(bench, votes.elo(V.votes(spark, sf))), 4)


@query(
    f"""{_BENCH}, {_DOMAIN_ELO}, cv AS (SELECT replace(model, 'src', 'm') AS model, domain, composite FROM cm),
am AS (SELECT DISTINCT model FROM cv), x AS (SELECT am.model, d.domain, composite, elo FROM am CROSS JOIN (VALUES ('email'), ('essay'), ('slack'), ('social')) d(domain)
  LEFT JOIN cv ON cv.model = am.model AND cv.domain = d.domain LEFT JOIN dr ON dr.model = am.model AND dr.domain = d.domain)
SELECT model, domain, round(0.4 * CASE WHEN elo IS NULL OR count(elo) OVER w < 2 THEN 50.0 ELSE 100.0 * (elo - min(elo) OVER w) / greatest(1e-9, max(elo) OVER w - min(elo) OVER w) END
+ 0.6 * least(100.0, greatest(0.0, 100 - composite)), 4) AS score FROM x WINDOW w AS (PARTITION BY domain)"""
)
def domain_human_score(spark: SparkSession, sf: str) -> DataFrame:
    bench = scoring.board(_scores(spark, sf)).withColumn("model", F.regexp_replace("model", "src", "m"))
    return _rounded(votes.domain_human_score(bench, votes.elo(V.votes(spark, sf), "domain")), 4)


_NAMES = [("m0", "Model Zero", "Lab A"), ("m1", "Model One", "Lab B")]
_BLENDED = "CASE WHEN CAST(substr(model, 2) AS INT) % 5 = 4 THEN NULL ELSE 1.5 + CAST(substr(model, 2) AS INT) * 7 % 11 END"


@query(
    f"""{_BENCH}, {_ELO.format('true')}, x AS (SELECT be.model, coalesce(elo, 1400) AS score, CAST({_BLENDED} AS DOUBLE) AS blended FROM be LEFT JOIN r USING (model))
SELECT (SELECT model FROM x ORDER BY score DESC, model LIMIT 1) AS best, (SELECT model FROM x ORDER BY score, model DESC LIMIT 1) AS worst,
(SELECT model FROM x WHERE blended IS NOT NULL ORDER BY blended DESC, model LIMIT 1) AS priciest, (SELECT model FROM x WHERE blended <= 3 ORDER BY score DESC, model LIMIT 1) AS best_cheap"""
)
def board_highlights(spark: SparkSession, sf: str) -> DataFrame:
    return reports.highlights(_priced(spark, sf))


def _priced(spark: SparkSession, sf: str) -> DataFrame:
    models = V.table(spark, sf, "documents").select(F.regexp_replace("source", "src", "m").alias("model")).distinct()
    rated = models.join(F.broadcast(votes.elo(V.votes(spark, sf)).select("model", "elo")), "model", "left")
    return rated.select("model", F.coalesce("elo", F.lit(1400)).alias("score"), F.expr(f"CAST({_BLENDED} AS DOUBLE)").alias("blended"))


@query(
    f"""{VOTES}, b AS (SELECT DISTINCT replace(source, 'src', 'm') AS model FROM documents), {_ELO.format('true')},
x AS (SELECT b.model, coalesce(elo, 1400) AS score, CAST({_BLENDED} AS DOUBLE) AS blended FROM b LEFT JOIN r USING (model))
SELECT model, CASE model WHEN 'm0' THEN 'Model Zero' WHEN 'm1' THEN 'Model One' ELSE model END AS name, CASE model WHEN 'm0' THEN 'Lab A' WHEN 'm1' THEN 'Lab B' ELSE '' END AS lab,
round(log10(blended), 6) AS x, score AS y FROM x WHERE blended IS NOT NULL"""
)
def price_scatter(spark: SparkSession, sf: str) -> DataFrame:
    """Named models by the logarithm of their price and their rating."""
    axis = reports.price_axis(_priced(spark, sf))
    return _rounded(reports.with_names(axis, spark.createDataFrame(_NAMES, "model string, name string, lab string")).select("model", "name", "lab", "x", "y"))


# Lines of a score log in its format.
LOG = """model                       email    essay    slack   social    OVERALL
mistral-large                39.9     42.6     32.1     47.8       40.6
claude-fable-5               43.4     32.1     27.0     39.8       35.6
broken-row                    n/a     32.1     27.0     39.8       35.6

model                     conciseness   templating       rhythm        tells
mistral-large                     4.7         91.2          6.1         43.2
claude-fable-5                   17.8         65.8          6.9         35.5

sensitivity (500 random reweightings, each axis 0.10-0.45):
      rank  model                      score   spread
         1  mistral-large              40.6   ranks 1
         2  claude-fable-5             35.6   ranks 2–3

TIE GROUPS"""


@query(
    """SELECT * FROM (VALUES ('mistral-large', 39.9::DOUBLE, 42.6::DOUBLE, 32.1::DOUBLE, 47.8::DOUBLE, 40.6::DOUBLE, 4.7::DOUBLE, 91.2::DOUBLE, 6.1::DOUBLE, 43.2::DOUBLE, 1, '1'),
('claude-fable-5', 43.4, 32.1, 27.0, 39.8, 35.6, 17.8, 65.8, 6.9, 35.5, 2, '2–3'))
v(model, email, essay, slack, social, overall, conciseness, templating, rhythm, tells, "rank", spread)"""
)
def log_parse(spark: SparkSession, sf: str) -> DataFrame:
    return reports.parse_log(spark.createDataFrame(list(enumerate(LOG.split("\n"))), "n int, value string"))


@query(ORACLES["rate_limit"])
def stream_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """The rate limit as a stream over the events, run to its end: the same rows as the batch fold gives."""
    folder = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    V.votes(spark, sf).select("seq", "t", "iph", "fp").write.parquet(f"{folder}/in")
    source = spark.readStream.schema("seq bigint, t bigint, iph string, fp string").parquet(f"{folder}/in")
    found = stream.rate_limited(source, per_pair=20, per_address=100, idle_ms=None)
    run = found.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("seq", "iph", "fp", "reason")
