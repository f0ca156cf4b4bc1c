"""Operator 4, mixing sources to target weights: Sainte-Lague apportionment of equal-token blocks.

Sizes are summed by source; targets fill up by weight under their caps. The blocks that the targets hold are given to
sources by highest quotients size / (2 k + 1), and each source's blocks to its shards in the same way. A shard lays its
documents out in seeded order and cuts them into blocks; with quota q of n blocks, each is taken floor(q / n) times and
q mod n of them once more: those where (block * q + seed) mod n passes n, which are exactly so many, evenly spread, and
can be counted over a document's blocks without listing them.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from proseline.llm.common import WORD, cut, guarded

WEIGHTS = (3, 1, 2)
SHARE, LIMIT = 1.5, 2
#: Words in a block; documents in a shard, about.
BLOCK, SHARD = 16, 20_000
SEED = "mix"


def sainte_lague(values: list[float], seats: int) -> list[int]:
    """Integer seats by highest quotients value / (2 k + 1); ties go to the earlier value."""
    total = sum(values)
    if not total or not seats:
        return [0] * len(values)
    quota = [int(v * seats / total + 0.5) for v in values]
    spare = seats - sum(quota)
    if spare > 0:
        heap = [(-v / (2 * q + 1), i) for i, (v, q) in enumerate(zip(values, quota, strict=True))]
        heapq.heapify(heap)
        for _ in range(spare):
            _, i = heap[0]
            quota[i] += 1
            heapq.heapreplace(heap, (-values[i] / (2 * quota[i] + 1), i))
    elif spare < 0:
        heap = [(v / (2 * q - 1), -i) for i, (v, q) in enumerate(zip(values, quota, strict=True)) if q]
        heapq.heapify(heap)
        for _ in range(-spare):
            _, i = heapq.heappop(heap)
            quota[-i] -= 1
            if quota[-i]:
                heapq.heappush(heap, (values[-i] / (2 * quota[-i] - 1), i))
    return quota


def targets(sizes: list[float], share: float = SHARE, limit: float = LIMIT, weights=WEIGHTS) -> list[float]:
    """Each source's target: its weight's part of share of all sizes, the excess over limit times its size reshared."""
    left, out, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i % len(weights)] for i in open_)
        over = {i for i in open_ if unit * weights[i % len(weights)] >= limit * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i % len(weights)]
            break
        for i in over:
            out[i] = float(limit * sizes[i])
        left, open_ = left - sum(out[i] for i in over), open_ - over
        if left <= 0:
            break
    return out


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def quotas(shards: DataFrame, block: int, share: float, limit: float, weights: tuple[int, ...]) -> DataFrame:
    """shards (source, shard, n docs, size) with source_size, target and quota.

    One task sees all shards' counts: a row for some 20,000 documents.
    """

    def run(found: pd.DataFrame) -> pd.DataFrame:
        named = found["source"].notna()
        order = {s: i for i, s in enumerate(sorted(set(found.loc[named, "source"]), key=lambda s: s.encode()))}
        found["_i"] = [order[s] if ok else len(order) for s, ok in zip(found["source"], named, strict=True)]
        found = found.sort_values(["_i", "shard"]).reset_index(drop=True)
        sizes = [int(x) for x in found.groupby("_i")["size"].sum()]
        goal = targets(sizes, share, limit, weights)
        blocks = sainte_lague(goal, round(sum(goal) / block))
        out = []
        for i, own in found.groupby("_i"):
            cap = [limit * -(-int(x) // block) for x in own["size"]]
            give = sainte_lague([float(x) for x in own["size"]], blocks[i])
            out.append(own.assign(source_size=sizes[i], target=goal[i], quota=[min(x, y) for x, y in zip(give, cap, strict=True)]))
        out = pd.concat(out).rename(columns={"size": "shard_size"})
        return out[["source", "shard", "shard_size", "source_size", "target", "quota"]]

    kind = shards.schema["source"].dataType.simpleString()
    return (
        shards.groupBy("_all")
        .applyInPandas(run, f"source {kind}, shard bigint, shard_size bigint, source_size bigint, target double, quota bigint")
    )


def mix(
    docs: DataFrame,
    block: int = BLOCK,
    share: float = SHARE,
    limit: int = LIMIT,
    weights: tuple[int, ...] = WEIGHTS,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and, for the text's cut, the place in its shard.

    A null text has size 0; a null source is a source of its own, the last. Rows of one doc_id stand side by side in
    seeded order, so repeated rows get the same set of values in any run. No rows give none; other columns are ignored.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string")))
    sized = cut(docs.select("doc_id", "source", words(F.col("text")).alias("size"), key.alias("_key")), docs.count(), dealt=True)
    rows = sized.groupBy("source").agg(F.count("*").alias("_rows"))
    known = rows.select(F.col("source").alias("_source"), F.ceil(F.col("_rows") / SHARD).alias("_shards"))
    spread = F.conv(F.substring(F.md5(F.concat("_key", F.col("size").cast("string"))), 1, 8), 16, 10).cast("bigint")
    dealt = (
        sized.join(known, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("shard", F.pmod(spread, F.col("_shards")).cast("bigint"))
        .drop("_source", "_shards")
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("size")).withColumn("_all", F.lit(0))
    given = quotas(cut(shards.coalesce(1)), block, share, limit, weights).select(
        F.col("source").alias("_source"), F.col("shard").alias("_shard"), "shard_size", "source_size", "target", "quota"
    )
    line = Window.partitionBy("source", "shard").orderBy("_key", "doc_id", "size")
    placed = dealt.withColumn("_end", F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    placed = placed.join(given, F.col("source").eqNullSafe(F.col("_source")) & (F.col("shard") == F.col("_shard")))
    n = F.greatest(F.ceil(F.col("shard_size") / block), F.lit(1)).cast("bigint")
    start = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "source", F.col("shard").cast("string"))), 1, 7), 16, 10)
    placed = placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        (F.col("_end") - F.col("size")).alias("begin"),
        F.col("_end").alias("end"),
        F.expr("quota").alias("quota"),
        n.alias("blocks"),
        F.pmod(start.cast("bigint"), n).alias("turn"),
    ).withColumns({"rest": F.expr("quota % blocks"), "rounds": F.expr("quota div blocks")})
    return placed.withColumn(
        "taken", F.expr(f"rounds * size + ({taken_before('end', block)}) - ({taken_before('begin', block)})")
    )


def taken_before(at: str, block: int) -> str:
    """SQL for how many of a shard's first `at` words stand in the blocks that are taken once more."""
    chosen = lambda b: f"(({b}) * rest + turn) div blocks - turn div blocks"
    whole = f"({at}) div {block}"
    one_more = f"(({chosen(f'{whole} + 1')}) - ({chosen(whole)}))"
    return f"({chosen(whole)}) * {block} + {one_more} * (({at}) % {block})"


def rounds_of(row: dict, block: int) -> np.ndarray:
    """How often each word of a document is taken, given its place in its shard."""
    at = np.arange(row["begin"], row["end"], dtype=np.int64) // block
    n, rest, turn = row["blocks"], row["rest"], row["turn"]
    return row["rounds"] + ((at + 1) * rest + turn) // n - (at * rest + turn) // n


def taken_text(text: str, keep: np.ndarray) -> str:
    """The words to keep: the text itself if that is all, else its runs of kept words, a space between them."""
    if keep.all():
        return text
    data = text.encode()
    places = [m.span() for m in re.finditer(rb"[^ \t-\r]+", data)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], keep.astype(np.int8), [0]])))
    return b" ".join(data[places[a][0] : places[b - 1][1]] for a, b in edge.reshape(-1, 2)).decode()


def mixed_documents(docs: DataFrame, block: int = BLOCK, **how) -> DataFrame:
    """docs as the mix takes them: a row for each round of a document, with the words of that round.

    A document of which nothing is taken goes, as do those without words; columns are those of docs, n_chars (where
    there) counted again. Rows of one doc_id and size are told apart by number.
    """
    docs, given = guarded(docs)
    same = Window.partitionBy("doc_id", "_size")
    places = mix(docs, block, **how).select(
        F.col("doc_id").alias("_id"), F.col("size").alias("_of"), "begin", "end", "rest", "rounds", "turn", "blocks", "taken"
    )
    places = places.withColumn("_n", F.row_number().over(Window.partitionBy("_id", "_of").orderBy("begin"))).where("taken > 0")
    names = list(docs.columns)
    rows = docs.withColumn("_size", words(F.col("text")))
    rows = rows.withColumn("_nth", F.row_number().over(same.orderBy(F.xxhash64("text"))))
    where = rows["doc_id"].eqNullSafe(places["_id"]) & (rows["_size"] == places["_of"]) & (rows["_nth"] == places["_n"])
    joined = rows.join(places, where).select(*[rows[n] for n in names], "begin", "end", "rest", "rounds", "turn", "blocks")

    def run(batches):
        for batch in batches:
            take, texts = [], []
            own = batch.select(["begin", "end", "rest", "rounds", "turn", "blocks"]).to_pylist()
            for i, (text, row) in enumerate(zip(batch.column("text").to_pylist(), own, strict=True)):
                times = rounds_of(row, block)
                for k in range(1, int(times.max()) + 1):
                    take.append(i)
                    texts.append(taken_text(text, times >= k))
            kept = batch.select(names).take(pa.array(take, pa.int64()))
            columns = dict(zip(names, kept.columns, strict=True))
            columns["text"] = pa.array(texts, pa.string())
            if "n_chars" in columns:
                columns["n_chars"] = pa.array(map(len, texts), columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return joined.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema.fields])).toDF(*given)
