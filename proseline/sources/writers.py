"""Writers: ordered JSON lines, corpora with sequential ids, JSON reports, dated snapshots."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseline.operators.resample import numbered


def json_lines(df: DataFrame, path: str, order: list[str] | None = None) -> None:
    """df as JSON lines, in global order over the part files where an order is given."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").json(path)


def corpus(df: DataFrame, path: str, prefix: str, order: str) -> None:
    """id (prefix-000001 ...), text and words, in order."""
    kept = numbered(df, prefix, order)
    kept.select("id", *[c for c in ("text", "words", "n_messages") if c in kept.columns]).write.mode("overwrite").json(path)


def report(df: DataFrame, path: str) -> None:
    """A report (few rows) as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)


def funnel_map(funnel: DataFrame) -> DataFrame:
    """One row: the funnel as a map from stage to rows kept."""
    entries = F.sort_array(F.collect_list(F.struct("number", F.concat_ws("_", "number", "stage").alias("k"), F.col("kept").alias("v"))))
    return funnel.agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["k"], x["v"]))).alias("funnel"))


def snapshot(votes: DataFrame, folder: str, at: datetime | None = None) -> str:
    """The log as JSON lines under a name with date and time; returns the path."""
    path = f"{folder}/votes-{(at or datetime.now(UTC)):%Y%m%d-%H%M}.jsonl"
    votes.write.mode("errorifexists").json(path)
    return path


def console_table(df: DataFrame, order: list[str], width: int = 13, first: int = 24, digits: int = 1, rows: int = 1000) -> str:
    """A report of up to `rows` rows as fixed-width text: the first column to the left, numbers to the right, n/a for null."""
    def cell(x: object, size: int) -> str:
        return ("n/a" if x is None else f"{x:.{digits}f}" if isinstance(x, float) else str(x)).rjust(size)

    names = df.columns
    head = names[0].ljust(first) + "".join(n[: width - 2].rjust(width) for n in names[1:])
    found = df.orderBy(*order).limit(rows).collect()
    return "\n".join([head, *(str(r[0]).ljust(first) + "".join(cell(x, width) for x in r[1:]) for r in found)])
