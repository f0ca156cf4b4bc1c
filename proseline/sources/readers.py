"""Readers of every input form: JSON lines, nested reports, text, XML and Parquet corpora, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

USAGE = (
    "struct<prompt_tokens: bigint, completion_tokens: bigint, reasoning_tokens: bigint, cost_usd: double, "
    "cost_estimated: boolean, model_id: string, latency_s: double, retried_8k: boolean>"
)
DETECTOR = (
    "struct<ai_likelihood: double, prediction: string, fraction_ai: double, fraction_ai_assisted: double, fraction_human: double, "
    "max_ai_likelihood: double, avg_ai_likelihood: double, n_windows: int, window_scores: array<double>, "
    "window_labels: array<string>, raw_keys: array<string>>"
)
OUTPUTS = (
    "scenario_id string, domain string, category string, model string, sample int, system string, user_prompt string, "
    f"text string, length_target array<int>, error string, kind string, source string, usage {USAGE}, pangram {DETECTOR}"
)
VOTES = "t bigint, m string, w string, l string, o string, s string, fp string, iph string, c string, d bigint"
CLEAN = "id string, text string, words bigint, n_messages bigint"
SCENARIOS = (
    "id string, domain string, category string, persona string, recipient string, "
    "context_thread array<struct<`from`: string, text: string>>, prompt string, length_target struct<words: array<int>>"
)
TELL = "struct<pooled_rate_per_1k_words: double, mean: double, share: double, total_hits: bigint>"


def outputs(spark: SparkSession, path: str) -> DataFrame:
    """Generated texts; blank lines are no rows."""
    return spark.read.schema(OUTPUTS).json(path)


def scored_or_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """scored.jsonl of a run's folder, or its outputs.jsonl if there is none."""
    try:
        return outputs(spark, f"{folder}/scored.jsonl")
    except AnalysisException:
        return outputs(spark, f"{folder}/outputs.jsonl")


def clean_corpus(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CLEAN).json(path)


def baseline(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """domain, tell, human_rate of a nested report whose tells are numbers or structs of numbers."""
    raw = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    tells = raw.select(F.explode(F.expr("cast(variant_get(v, '$.tells_per_1k_words', 'map<string, variant>') as map<string, variant>)")).alias("tell", "x"))
    rate = F.coalesce(
        F.expr("try_variant_get(x, '$.pooled_rate_per_1k_words', 'double')"), F.expr("try_variant_get(x, '$', 'double')")
    )
    return tells.select(F.lit(domain).alias("domain"), "tell", rate.alias("human_rate"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of each file, as UTF-8 or else, where it isn't that, as Latin-1."""
    raw = spark.read.format("binaryFile").load(path)
    utf8 = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    return raw.select("path", F.coalesce(utf8, F.decode("content", "ISO-8859-1")).alias("text"))


def chat_xml(spark: SparkSession, path: str) -> DataFrame:
    """(channel, ts, author, text) of message elements that have all three, a readable time and some text."""
    raw = spark.read.format("xml").schema("ts string, user string, text string").option("rowTag", "message").load(path)
    return (
        raw.withColumn("channel", F.input_file_name())
        .select("channel", F.expr("try_cast(trim(ts) as timestamp_ntz)").alias("ts"), F.trim("user").alias("author"), "text")
        .where("ts is not null and author is not null and trim(coalesce(text, '')) <> ''")
    )


def post_corpus(spark: SparkSession, path: str) -> DataFrame:
    """The text column of Parquet posts; no other column is read."""
    return spark.read.parquet(path).select("text")


def scenarios(spark: SparkSession, folder: str) -> DataFrame:
    """Scenario packs of the four domains; a pack that isn't there is skipped."""
    found = None
    for domain in ("email", "social", "essay", "slack"):
        try:
            own = spark.read.schema(SCENARIOS).option("multiLine", True).json(f"{folder}/{domain}.json")
        except AnalysisException:
            continue
        found = own if found is None else found.unionByName(own)
    return spark.createDataFrame([], SCENARIOS) if found is None else found


def setups(spark: SparkSession, path: str) -> DataFrame:
    """(scenario, setup) of a JSON object of texts."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", "map<string, string>")).alias("scenario", "setup"))


def votes(spark: SparkSession, path: str) -> DataFrame:
    """The vote log in order: seq by file and line, malformed lines dropped."""
    raw = spark.read.text(path).withColumns({"_file": F.input_file_name(), "seq": F.monotonically_increasing_id()})
    rows = raw.select("seq", F.from_json("value", VOTES + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("v"))
    return rows.where("v is not null and v._bad is null").select("seq", "v.*").drop("_bad")


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(n, value): the lines of one text file with their numbers from 0."""
    return spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "value"))


# How a prompt names who is speaking.
SPEAKERS = {"recipient": "They wrote", "persona": "I previously wrote", "other": "Context"}


def prompts(scenarios_: DataFrame) -> DataFrame:
    """id and prompt: the writer, the one written to, the thread with its speakers, a blank line, and the request."""
    def who(m: Column) -> Column:
        return reduce(lambda found, x: found.when(m["from"] == x[0], x[1]), SPEAKERS.items(), F.when(F.lit(False), "")).otherwise("Context")

    said = F.transform(F.coalesce("context_thread", F.array()), lambda m: F.concat(who(m), F.lit(': "'), m["text"], F.lit('"')))
    lines = F.concat(
        F.array(F.concat(F.lit("About me: "), "persona")),
        F.array(F.when(F.coalesce("recipient", F.lit("")) != "", F.concat(F.lit("Who this is going to: "), "recipient"))),
        said,
        F.array(F.concat(F.lit("\n"), "prompt")),
    )
    return scenarios_.select("id", F.array_join(lines, "\n").alias("prompt"))


def with_setups(outputs_: DataFrame, setups_: DataFrame) -> DataFrame:
    """outputs (scenario, ...) with setup, empty where a scenario has none."""
    return outputs_.join(F.broadcast(setups_), "scenario", "left").withColumn("setup", F.coalesce("setup", F.lit("")))


def pairs_to_map(flat: DataFrame, column: str = "flat") -> DataFrame:
    """flat with its array of keys and values in turn as a map; of a key that comes twice the last value counts."""
    flat_ = F.col(column)
    numbers = F.sequence(F.lit(0), (F.size(flat_) / 2).cast("int") - 1)
    entries = F.transform(numbers, lambda i: F.struct(F.get(flat_, 2 * i).alias("k"), F.get(flat_, 2 * i + 1).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["k"] == e["k"]))
    none = F.expr("cast(map() as map<string, string>)")
    return flat.withColumn(column, F.when(F.size(F.coalesce(flat_, F.array())) < 2, none).otherwise(F.map_from_entries(last)))


def generation_plan(models: DataFrame, scenarios_: DataFrame, samples: int) -> DataFrame:
    """model, scenario and sample of each text to be generated: a list of work, the product of two small tables."""
    numbered = scenarios_.select(F.col("id").alias("scenario"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("sample"))
    return numbered.join(F.broadcast(models.select("model")))
