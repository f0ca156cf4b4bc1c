"""The driver's tables as the engine's inputs: generated texts, human texts, votes; with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_G = "CAST(floor(doc_id/20.0) AS BIGINT)"
#: The same text in Spark and DuckDB: greetings, blank lines and phrases by document.
DECORATED = f"""concat(
  CASE WHEN ({_G} + doc_id) % 7 = 3 THEN concat('Hi team,', chr(10), chr(10)) ELSE '' END,
  CASE WHEN {_G} % 2 = 0 THEN replace(text, chr(10), concat(chr(10), chr(10))) ELSE text END,
  CASE ({_G} + 2 * (doc_id % 20)) % 10
    WHEN 0 THEN ' We delve deeper — and leverage robust tools.'
    WHEN 1 THEN ' I wanted to reach out -- let us circle back.'
    WHEN 2 THEN ' This is not just fast, but seamless - truly.'
    WHEN 3 THEN ' Planning, building, and shipping. Best regards'
    WHEN 4 THEN ' Sorry for the delay.'
    WHEN 5 THEN ' I hope this email finds you well, a testament to our work – really.'
    WHEN 6 THEN ' We are thrilled to announce it. Please don''t hesitate.'
    WHEN 7 THEN ' Let that sink in. As an AI I agree.'
    WHEN 8 THEN ' Could you send it? Unfortunately the meeting is on monday.'
    ELSE ' Thanks, and see the attached update.' END)"""
_DOMAIN = f"CASE {_G} % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'essay' WHEN 2 THEN 'slack' ELSE 'social' END"
_SCENARIO = f"concat({_DOMAIN}, '.', CAST(CAST(floor({_G}/4.0) AS BIGINT) % 3 AS STRING))"
_BAND = f"CASE {_G} % 4 WHEN 0 THEN 120 WHEN 1 THEN 300 WHEN 2 THEN 60 ELSE 40 END"
_COLUMNS = f"doc_id, source AS model, {_DOMAIN} AS domain, {_SCENARIO} AS scenario, CAST({_BAND} AS BIGINT) AS band_hi"

OUTPUTS_SQL = f"SELECT {_COLUMNS}, {DECORATED} AS text FROM documents"
HUMAN_SQL = f"""SELECT doc_id, {_DOMAIN} AS domain,
  CASE WHEN {_G} % 3 = 0 THEN {DECORATED} ELSE replace(text, chr(10), concat(chr(10), chr(10))) END AS text
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)"""

_W, _L = "CAST(user_id % 18 AS BIGINT)", "CAST((user_id + 1 + event_id % 17) % 18 AS BIGINT)"
_VOTE_DOMAIN = "CASE event_id % 4 WHEN 0 THEN 'email' WHEN 1 THEN 'essay' WHEN 2 THEN 'slack' ELSE 'social' END"
_VOTE_COLUMNS = f"""event_id AS seq, 'v1' AS mode, concat('m', CAST({_W} AS STRING)) AS w, concat('m', CAST({_L} AS STRING)) AS l,
  CASE WHEN event_type = 'view' THEN 'both' ELSE 'win' END AS o, concat('c', CAST(event_id % 5 AS STRING)) AS c,
  concat({_VOTE_DOMAIN}, '.', CAST(event_id % 7 AS STRING)) AS scenario, {_VOTE_DOMAIN} AS domain,
  CAST(user_id AS STRING) AS fp, CAST(user_id % 20 AS STRING) AS iph, CAST(floor(value * 100) AS BIGINT) AS dwell,
  event_type = 'error' AS attention"""
#: Time runs 3600 times faster than in the table, so that votes come close enough for the rate limit.
VOTES_SQL = f"SELECT {_VOTE_COLUMNS}, CAST(floor((epoch_us(ts) - 1704067200000000) / 3600000.0) AS BIGINT) AS t FROM events"


#: Every scenario that a document can be of, by domain.
SCENARIOS = {d: [f"{d}.{i}" for i in range(3)] for d in ("email", "essay", "slack", "social")}


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as run at once, where its files give fewer: reading texts costs far more than moving them.

    Tables with more splits than that, as large ones have, stay as they are.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df


#: Rows in an Arrow batch: Spark's own 10,000 whole texts cost each Python worker hundreds of MB.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as the queries read it; tables of texts set smaller Arrow batches where the session leaves that open."""
    if name in ("documents", "pages") and spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name == "documents" else df


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, model, domain, scenario, band_hi, text."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.selectExpr(*_split(_COLUMNS), f"{DECORATED} AS text")


def human(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, text of documents labelled good."""
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    docs = table(spark, sf_dir, "documents").join(good, "doc_id", "left_semi")
    text = f"CASE WHEN {_G} % 3 = 0 THEN {DECORATED} ELSE replace(text, chr(10), concat(chr(10), chr(10))) END AS text"
    return docs.selectExpr("doc_id", f"{_DOMAIN} AS domain", text)


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    micros = "unix_micros(CAST(ts AS TIMESTAMP))"
    t = f"CAST(floor(({micros} - 1704067200000000) / 3600000.0) AS BIGINT) AS t"
    return table(spark, sf_dir, "events").selectExpr(*_split(_VOTE_COLUMNS), t)


def roster(spark: SparkSession, n: int = 16) -> DataFrame:
    """Models that votes may name; two of the eighteen in the events aren't among them."""
    return spark.range(n).select(F.concat(F.lit("m"), F.col("id").cast("string")).alias("model"))


def _split(columns: str) -> list[str]:
    """A select list cut at its outer commas."""
    out, depth, start, quoted = [], 0, 0, False
    for i, c in enumerate(columns):
        quoted ^= c == "'"
        depth += not quoted and (c == "(") - (c == ")")
        if c == "," and not depth and not quoted:
            out.append(columns[start:i])
            start = i + 1
    return [*out, columns[start:]]
