"""Operator 6, suffix-array deduplication over a sparse set of suffixes.

Of a text's suffixes (at word borders), only those at minimisers are kept: where the hash of the next GRAM words is the
least of some SPAN neighbouring places. Equal passages have equal minimisers, so of any passage of LEAST words or more
that two documents share, both keep a suffix in its first SPAN places, whose first KEY = LEAST - SPAN + 1 words lie in the
passage. Keys that two documents have mark suffixes to look at; counting them needs no sort and is combined before the
shuffle, so that a passage of a third of all documents costs no task more than others. Each suffix is compared with
one partner, the first place that has its key (the last for the first document itself). Neighbouring suffixes whose
partners are as far apart as they are make a run: all its words stand in the partner in a row. At a run's first and last
suffix all windows of LEAST words around the key are compared with those of all documents that have the key; so what
counts is exactly the windows of LEAST words that another document has too.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseline.llm.common import body, cut, guarded, slices, split_join
from proseline.llm.words import Hashes, Powers, hashed, windows

LEAST, SPAN, GRAM = 50, 16, 8


def minimisers(grams: np.ndarray, span: int) -> np.ndarray:
    """Places whose value is the least of some span neighbouring places (of all, if there are fewer)."""
    if len(grams) <= span:
        return np.flatnonzero(grams == grams.min()) if len(grams) else np.zeros(0, np.int64)

    def sliding(x: np.ndarray, n: int, f) -> np.ndarray:
        size = 1
        while size < n:
            step = min(size, n - size)
            x = f(x[:-step], x[step:])
            size += step
        return x

    least = sliding(grams, span, np.minimum)
    edge = np.zeros(span - 1, np.uint64)
    return np.flatnonzero(sliding(np.concatenate([edge, least, edge]), span, np.maximum) == grams)


def suffixes(docs: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """(key, doc_id, pos): the suffixes at minimisers that have least - span + 1 words or more. pos counts words."""
    size = least - span + 1

    def run(batches):
        known, powers = Hashes(), Powers()
        for batch in slices(batches):
            keys, places, rows = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                words = hashed(text, known)
                if len(words) < size:
                    continue
                up, down = powers(len(words))
                at = minimisers(windows(words, GRAM, up, down), span)
                at = at[at <= len(words) - size]
                keys.append(windows(words, size, up, down)[at].view(np.int64))
                places.append(at.astype(np.int32))
                rows.append(np.full(len(at), i))
            if keys:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(keys)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places))],
                    names=["key", "doc_id", "pos"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("doc_id is not null").select("doc_id", body().alias("body")).mapInArrow(run, f"key bigint, doc_id {kind}, pos int")


def passages(docs: DataFrame, wanted: DataFrame, least: int, span: int) -> DataFrame:
    """(doc_id, run, start, hashes): for wanted suffixes (doc_id, pos, edge, run) the hashes of all windows of `least` words
    that begin in the `span` places up to pos, for the places from start on in a row.

    Suffixes at an edge give a row each, with their run; the others of a document are put together and have none.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    marks = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "edge", "run")).alias("marks"))

    def run(batches):
        known, powers = Hashes(), Powers()
        for batch in slices(batches):
            rows, runs, starts, out = [], [], [], []
            for i, (text, own) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = hashed(text, known)
                found = windows(words, least, *powers(len(words))).view(np.int64)
                ranges, done = [(max(0, m["pos"] - span + 1), m["pos"] + 1, m["run"]) for m in own if m["edge"]], 0
                for pos in sorted({m["pos"] for m in own if not m["edge"]}):
                    ranges.append((max(done, pos - span + 1), pos + 1, None))
                    done = pos + 1
                for first, end, number in ranges:
                    if first < min(end, len(found)):
                        rows.append(i)
                        runs.append(number)
                        starts.append(first)
                        out.append(found[first:end])
            if out:
                ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
                hashes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows)), pa.array(runs, pa.int64()), pa.array(starts, pa.int32()), hashes],
                    names=["doc_id", "run", "start", "hashes"],
                )

    texts = docs.where("doc_id is not null").select("doc_id", body().alias("body"))
    return texts.join(marks, "doc_id").mapInArrow(run, f"doc_id {kind}, run bigint, start int, hashes array<bigint>")


def extensions(found: DataFrame, least: int, later_only: bool = False) -> DataFrame:
    """(doc_id, run, low, high): from where to where windows of `least` words at each run's first and last suffix reach
    that another document has too; with later_only, one of smaller doc_id.

    A window is compared as a whole with all documents' windows, by its hash, so neither other copies in its own
    document nor documents that share only one of its ends decide it. Counts are combined before the shuffle.
    """
    n = found.agg(F.sum(F.size("hashes"))).first()[0] or 0
    each = found.select("doc_id", F.explode("hashes").alias("window"))
    shared = each.groupBy("window").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n"))
    shared = cut(shared.where("lo < hi"), n // 2)
    own = found.where("run is not null").select("doc_id", "run", "start", F.posexplode("hashes").alias("at", "window"))
    own = split_join(own, shared.select("window", "lo"), ["window"], shared)
    own = own.where("lo < doc_id" if later_only else "true").withColumn("from", F.col("start") + F.col("at"))
    return own.groupBy("doc_id", "run").agg(F.min("from").alias("low"), (F.max("from") + least).alias("high"))


def repeated(docs: DataFrame, least: int = LEAST, span: int = SPAN, later_only: bool = False) -> DataFrame:
    """doc_id, repeated_words and spans (array of start, end in words, ascending, apart) of documents with passages of
    `least` words or more that another document has too, in any case of ASCII letters.

    With later_only, of a passage's documents the one with the smallest doc_id has no span for it. Repeats within one
    document don't count. Rows of one doc_id are one document's parts, rows without doc_id and null or short texts have
    no spans; no rows give none; other columns are ignored.
    """
    size = least - span + 1
    letters = docs.where("doc_id is not null").agg(F.sum(F.octet_length(body()))).first()[0] or 0
    found = suffixes(docs, least, span)
    shared = found.groupBy("key").agg(
        F.min("doc_id").alias("lo"), F.min_by("pos", "doc_id").alias("lo_pos"),
        F.max("doc_id").alias("hi"), F.max_by("pos", "doc_id").alias("hi_pos"), F.count("*").alias("n"),
    )
    # about: words of six bytes, two of them kept in span + 1, and a shared key has two suffixes at least
    shared = cut(shared.where("lo < hi"), letters // (6 * (span + 1)))
    n = shared.agg(F.sum("n")).first()[0] or 0
    marks = split_join(found, shared, ["key"], shared)
    later = F.col("doc_id") > F.col("lo")
    marks = marks.select(
        "key", "doc_id", "pos", "n",
        (later if later_only else F.lit(True)).alias("counted"),
        F.when(later, F.col("lo")).otherwise(F.col("hi")).alias("partner"),
        (F.when(later, F.col("lo_pos")).otherwise(F.col("hi_pos")) - F.col("pos")).alias("shift"),
    ).distinct()
    line = Window.partitionBy("doc_id", "counted").orderBy("pos")

    def goes_on(step) -> Column:
        """Whether the neighbour's words and this suffix's stand in one partner in a row."""
        near = F.abs(step("pos").over(line) - F.col("pos")) <= size
        return F.coalesce(near & (step("partner").over(line) == F.col("partner")) & (step("shift").over(line) == F.col("shift")), F.lit(False))

    marks = marks.withColumns({"first": F.col("counted") & ~goes_on(F.lag), "last": F.col("counted") & ~goes_on(F.lead)})
    marks = cut(marks.withColumn("run", F.sum(F.col("first").cast("bigint")).over(line)).drop("partner", "shift"), n)
    # a document that shares only the words from a run's end on may have another suffix there, within span places of it
    of = Window.partitionBy("doc_id", "counted", "run")
    beside = (F.col("pos") - F.min("pos").over(of) < span) | (F.max("pos").over(of) - F.col("pos") < span)
    asked = marks.where("counted").withColumn("beside", beside).where("beside").groupBy("key").agg(F.first("n").alias("n"))
    wanted = split_join(marks.drop("n"), asked.select("key"), ["key"], asked).select("doc_id", "pos", (F.col("first") | F.col("last")).alias("edge"), "run")
    # its rows have some span hashes, as much as four other rows
    more = extensions(cut(passages(docs, wanted, least, span), 4 * n), least, later_only)
    runs = marks.where("counted").groupBy("doc_id", "run").agg(F.min("pos").alias("start"), (F.max("pos") + size).alias("end"))
    # a run shorter than a passage counts as far as its windows do
    long = F.col("end") - F.col("start") >= least
    whole = runs.join(more, ["doc_id", "run"], "left").select(
        "doc_id",
        F.when(long, F.least("start", "low")).otherwise(F.col("low")).cast("int").alias("start"),
        F.when(long, F.greatest("end", "high")).otherwise(F.col("high")).cast("int").alias("end"),
    )
    # spans whose extensions meet become one
    own = Window.partitionBy("doc_id").orderBy("start", "end")
    apart = F.coalesce(F.col("start") > F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True))
    whole = whole.where(F.col("end") - F.col("start") >= least).withColumn("apart", apart)
    joined = (
        whole.withColumn("part", F.sum(F.col("apart").cast("int")).over(own))
        .groupBy("doc_id", "part")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
    )
    return joined.groupBy("doc_id").agg(
        F.sum(F.col("end") - F.col("start")).cast("bigint").alias("repeated_words"),
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"),
    )


def without(text: bytes, spans: list[dict]) -> bytes:
    """The text without the words of spans; white space before a span goes with it."""
    places = [m.span() for m in re.finditer(rb"[^ \t-\r]+", text)]
    out, at = [], 0
    for s in spans:
        start, end = min(s["start"], len(places)), min(s["end"], len(places))
        if start < end:
            out.append(text[at : places[start - 1][1] if start else 0])
            at = places[end - 1][1]
    return b"".join([*out, text[at:]])


def remove_repeated(docs: DataFrame, least: int = LEAST, span: int = SPAN) -> DataFrame:
    """docs without passages that a document of smaller doc_id has too; what has no word left goes.

    Rows that lose nothing stay as they are, empty ones too; a row that loses something has n_chars (where docs has the
    column) counted again.
    """
    docs, given = guarded(docs)
    found = repeated(docs, least, span, later_only=True).select(F.col("doc_id").alias("_id"), "spans")
    names = docs.columns
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema.fields), T.StructField("_gone", T.BooleanType())])

    def run(batches):
        for batch in slices(batches):
            texts, spans = batch.column("text").to_pylist(), batch.column("spans").to_pylist()
            cut_ = [x if not s else without(x.encode(), s).decode().lstrip() for x, s in zip(texts, spans, strict=True)]
            gone = [bool(s) and not x.strip() for x, s in zip(cut_, spans, strict=True)]
            columns = {n: batch.column(n) for n in batch.schema.names if n != "spans"}
            columns["text"] = pa.array(cut_, pa.string())
            if "n_chars" in columns:
                sizes = [len(x) if s else n for x, s, n in zip(cut_, spans, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(sizes, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array(gone)], names=[*columns, "_gone"])

    joined = docs.join(found, docs["doc_id"] == found["_id"], "left").select(*[docs[n] for n in names], "spans")
    return joined.mapInArrow(run, schema).where("not _gone").select(*names).toDF(*given)
