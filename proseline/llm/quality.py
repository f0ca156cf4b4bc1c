"""Operator 3, quality rules: an isolation forest over rule statistics, its threshold calibrated on labelled rows.

Each text gives counts in one pass. Rules on them reject what they can alone; the forest judges the rest: trees split
random statistics at random points, and what is isolated by few splits is anomalous. Each tree grows from rows of its own,
as many as the method gives a tree, drawn from all labelled good rows; the threshold on the path length is the one that
best parts all labelled good and bad rows.
"""

from __future__ import annotations

import math
import operator
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from proseline.llm.common import FILE_ROWS, body, cut, slices

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: Trees, rows a tree grows from, and the seed of all draws.
TREES, SAMPLE, SEED = 128, 256, 7
#: Share of labelled good rows that the calibrated threshold may reject at most.
MOST_LOST = 0.002
_CONTINUED = bytes(range(0x80, 0xC0))
#: Whether a word has neither letter nor digit.
_BARE = re.compile(rb"[^A-Za-z0-9\x80-\xff]+").fullmatch
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Features and the change in each that counts as small.
FEATURES = {"symbol_rate": 0.1, "bare_rate": 0.05, "repeat_rate": 0.2, "adjacent_rate": 0.05, "dup_line_rate": 0.3, "type_rate": 0.1}


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that stand in a window of so many words which the text has twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    codes = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    # ranks of longer and longer windows: equal ranks are equal windows, so nothing is left to chance
    rank, span = codes, 1
    while span < window:
        step = min(span, window - span)
        pair = rank[: len(words) - span - step + 1] * (int(rank.max()) + 1) + rank[step : len(words) - span + 1]
        _, rank = np.unique(pair, return_inverse=True)
        span += step
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def statistics(text: bytes) -> tuple:
    """The contract's counts and the features of one text's UTF-8."""
    words = text.split()
    n = len(words)
    chars = len(text.translate(None, WHITE + _CONTINUED))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeated = repeated_words(words)
    if not n:
        return (0, chars, symbols, dup, repeated, *[0.0] * len(FEATURES))
    bare = sum(1 for w in words if _BARE(w))
    adjacent = sum(map(operator.eq, words, words[1:]))
    return (
        n, chars, symbols, dup, repeated,
        math.log1p(symbols / n), bare / n, repeated / n, adjacent / n, dup / max(1, len(lines)), math.log(len(set(words))) / math.log(n + 1),
    )


def rule_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the counts and the features of each row; a null text has no words."""

    def run(batches):
        for batch in slices(batches):
            if batch.num_rows:
                rows = list(zip(*map(statistics, batch.column(1).to_pylist()), strict=True))
                kinds = [pa.int64()] * len(STATISTICS) + [pa.float64()] * len(FEATURES)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))],
                    names=["doc_id", *STATISTICS, *FEATURES],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    named = ", ".join([*(f"{x} bigint" for x in STATISTICS), *(f"{x} double" for x in FEATURES)])
    return docs.select("doc_id", body().alias("body")).mapInArrow(run, f"doc_id {kind}, {named}")


def mean_path(n: np.ndarray | float) -> np.ndarray | float:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, float)
    return np.where(n > 1, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), 0.0)


class Forest:
    """Isolation trees as flat arrays."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = SAMPLE, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.size = min(sample, len(rows))
        limit = max(1, math.ceil(math.log2(max(2, self.size)))) + 4
        margins = list(FEATURES.values())
        self.trees = []
        # each tree has rows that no other has, if there are as many
        order = draw.permutation(len(rows)) if len(rows) >= trees * self.size else None
        for i in range(trees):
            nodes: list[list[float]] = []  # feature (-1: leaf), split, left, right, path length of a leaf

            def grow(own: np.ndarray, depth: int, nodes=nodes) -> int:
                at = len(nodes)
                nodes.append([-1, 0.0, 0, 0, depth + float(mean_path(len(own)))])
                if len(own) and depth < limit:
                    # splits may fall a small change beyond the rows' own range, so that what lies outside is isolated
                    f = int(draw.integers(len(margins)))
                    split = draw.uniform(own[:, f].min() - margins[f], own[:, f].max() + margins[f])
                    nodes[at][:2] = f, split
                    nodes[at][2] = grow(own[own[:, f] < split], depth + 1)
                    nodes[at][3] = grow(own[own[:, f] >= split], depth + 1)
                return at

            own = draw.choice(len(rows), self.size, replace=False) if order is None else order[i * self.size : (i + 1) * self.size]
            grow(rows[own], 0)
            a = np.array(nodes)
            self.trees.append((a[:, 0].astype(int), a[:, 1], a[:, 2].astype(int), a[:, 3].astype(int), a[:, 4]))

    def paths(self, rows: np.ndarray) -> np.ndarray:
        """Mean path length of each row over all trees."""
        total = np.zeros(len(rows))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(rows), int)
            open_ = np.arange(len(rows))
            while len(open_):
                f = feature[at[open_]]
                open_, f = open_[f >= 0], f[f >= 0]
                here = at[open_]
                at[open_] = np.where(rows[open_, f] < split[here], left[here], right[here])
            total += length[at]
        return total / len(self.trees)


def calibrate(paths: np.ndarray, good: np.ndarray, most_lost: float = MOST_LOST) -> float:
    """The threshold with the greatest balanced accuracy of those that reject at most that share of good rows."""
    if not len(paths) or good.all() or not good.any():
        return -math.inf
    at = np.unique(paths)
    cuts = np.concatenate([[-math.inf], (at[1:] + at[:-1]) / 2])
    lost = np.searchsorted(np.sort(paths[good]), cuts) / good.sum()
    caught = np.searchsorted(np.sort(paths[~good]), cuts) / (~good).sum()
    value = np.where(lost <= most_lost, caught - lost, -1)
    best = np.flatnonzero(value == value.max())
    return float(cuts[best[0]])


def calibrated(scored: DataFrame, n: int, most_lost: float = MOST_LOST) -> float:
    """What calibrate gives for the rows of scored (path, good; n of them), however many there are.

    Rows are counted by path; ranges of paths are cumulated each by itself, and what lies below a range is added.
    """
    scored = cut(scored, n)
    ranges = -(-n // FILE_ROWS)
    points = scored.agg(F.percentile_approx("path", [i / ranges for i in range(1, ranges)] or [0.5])).first()[0] or []
    counted = scored.groupBy("path").agg(F.count_if("good").alias("g"), F.count_if(~F.col("good")).alias("b"))
    ranged = counted.withColumn("_part", F.size(F.filter(F.lit(sorted(set(points))), lambda x: x <= F.col("path"))))
    below, g, b, last = [], 0, 0, None
    for r in ranged.groupBy("_part").agg(F.sum("g"), F.sum("b"), F.max("path")).orderBy("_part").collect():
        below.append((r[0], g, b, last))
        g, b, last = g + r[1], b + r[2], r[3]
    if not g or not b:
        return -math.inf
    below = scored.sparkSession.createDataFrame(below, "_part int, _g long, _b long, _last double")
    own = Window.partitionBy("_part").orderBy("path")
    before = {x: F.col(f"_{x}") + F.sum(x).over(own) - F.col(x) for x in "gb"}
    cuts = ranged.join(F.broadcast(below), "_part").select(
        "path", F.coalesce(F.lag("path").over(own), "_last").alias("low"), (before["g"] / g).alias("lost"), (before["b"] / b).alias("caught")
    )
    best = cuts.where(F.col("lost") <= most_lost).agg(F.max(F.struct(F.col("caught") - F.col("lost"), -F.col("path"), "low"))).first()[0]
    return -math.inf if best[2] is None else (best[2] - best[1]) / 2


def with_paths(found: DataFrame, forest: Forest | None, keep: list[str]) -> DataFrame:
    """keep's columns and path, the mean path length in the forest (infinite without one), of each row of found."""

    def run(batches):
        for batch in batches:
            values = np.column_stack([batch.column(n).to_numpy(zero_copy_only=False) for n in FEATURES])
            paths = forest.paths(values) if forest else np.full(len(values), math.inf)
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(paths, pa.float64())], names=[*keep, "path"])

    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in keep)
    return found.select(*keep, *FEATURES).mapInArrow(run, f"{kinds}, path double")


def lowest(rows: DataFrame, n: int, most: int) -> DataFrame:
    """Of n rows, the `most` that a hash of them puts first."""
    place = F.xxhash64(*rows.columns)
    if n > most:
        # rows below a bound on their hash are about as many as are asked for, so no task sends many more than its part
        rows = rows.where(F.shiftrightunsigned(place, 32) < int((most + 4 * most**0.5) / n * (1 << 32)))
    return rows.orderBy(place, *rows.columns).limit(most)


def judge(docs: DataFrame, labels: DataFrame, labelled: int | None = None) -> DataFrame:
    """doc_id, the counts, base_failed, path and kept of each row of docs.

    labels has doc_id and quality (1 good, 0 bad); null qualities and labels of no document are ignored, and labels that
    contradict each other count as bad. Trees draw their rows from all labelled good rows, and all labelled rows set the
    threshold; a caller may bound them to `labelled` rows, in order of a hash. Without labels of both kinds only the rules
    decide. A null text has no words and fails. Repeated rows get equal results; no rows give none.
    """
    found = rule_statistics(docs)
    base = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    found = cut(found.withColumn("base_failed", base))
    quality = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    usable = found.where("not base_failed").join(quality, "doc_id").select("doc_id", (F.col("quality") == 1).alias("good"), *FEATURES).distinct()
    if labelled is not None:
        usable = lowest(usable, usable.count(), labelled)
    tally = {r.good: r.n for r in usable.groupBy("good").agg(F.count("*").alias("n")).collect()}
    forest, threshold = None, -math.inf
    if len(tally) == 2:
        usable = cut(usable, sum(tally.values()))
        grown = lowest(usable.where("good"), tally[True], TREES * SAMPLE).toPandas()
        forest = Forest(grown[list(FEATURES)].to_numpy(float))
        threshold = calibrated(with_paths(usable, forest, ["good"]), sum(tally.values()))
    judged = with_paths(found, forest, ["doc_id", *STATISTICS, "base_failed"])
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("path") >= threshold))
