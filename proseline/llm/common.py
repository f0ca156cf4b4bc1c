"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from proseline.sources.folders import shared_folder

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is hot with more than this part of all rows, so there are at most HOT hot keys at any size; and with so many rows at least.
HOT, HOT_ROWS = 1000, 2048


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a small table that one file of it holds.
FILE_ROWS = 25_000


def files(rows: int) -> int:
    """How many files a table of so many short rows is written as."""
    return max(1, -(-rows // FILE_ROWS))


def cut(df: DataFrame, rows: int | None = None, dealt: bool = False) -> DataFrame:
    """Materialise df in the cluster's shared checkpoint folder and forget its lineage.

    rows, where it is known, is how many rows df has at most: a table of few rows then becomes few files. dealt: df's own
    tasks have much to do and stay as many as they are; their rows are shuffled into the files.
    """
    shared_folder(df.sparkSession)
    if rows is not None:
        df = df.repartition(files(rows)) if dealt else df.coalesce(files(rows))
    return df.checkpoint(eager=True)


#: Rows in an Arrow batch. A batch of Spark's own 10,000 texts costs an executor some 400 MB more than one of 500.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 500


def settings(spark: SparkSession) -> None:
    """What the registered queries and the pipeline, not the operators, set in their session where it leaves that open."""
    if spark.conf.get(BATCH, None) is None:
        spark.conf.set(BATCH, str(BATCH_ROWS))


def store(df: DataFrame) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def body(name: str = "text") -> Column:
    """The UTF-8 bytes of a text column; a null text is empty."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b""))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, so that a worker holds few whole texts as Python objects at a time.

    What Arrow keeps of a batch that is done is given back, since workers live on from task to task.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        batch = None
        pa.default_memory_pool().release_unused()


def split_join(big: DataFrame, small: DataFrame, keys: list[str], counted: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """big joined on keys to small, which has one row a key; the rows of hot keys are dealt to many tasks.

    counted has the keys and n, how many rows big has of each (counted in big unless given). Hot keys are those with
    more than a HOTth of all rows: HOT of them at most, however large the tables are, so their list can be broadcast.
    Rows of a hot key get a number each, from a hash of all their columns, and small's row of it is repeated for each number.
    """
    counted = big.groupBy(*keys).agg(F.count("*").alias("n")) if counted is None else counted
    counted = counted.select(*keys, "n").where(" and ".join(f"{k} is not null" for k in keys))
    total = counted.agg(F.sum("n")).first()[0] or 0
    least = max(total // HOT, HOT_ROWS)
    hot = counted.where(F.col("n") > least).select(*keys, F.ceil(F.col("n") / least).cast("int").alias("_parts")).collect()
    if not hot:
        return big.join(small, keys, how)
    kinds = {f.name: f.dataType.simpleString() for f in small.schema}
    hot = big.sparkSession.createDataFrame(hot, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "_parts int"]))
    number = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.col("_parts")).cast("int")
    dealt = big.join(F.broadcast(hot), keys, "left")
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
    if len(keys) > 1 or kinds[keys[0]] != "bigint" or how != "inner":
        dealt = dealt.withColumn("_part", F.coalesce(number, F.lit(0)))
        return dealt.drop("_parts").join(repeated.drop("_parts"), [*keys, "_part"], how).drop("_part")
    # a 64-bit key and its part make one 64-bit key, so that no row gets wider
    mixed = lambda part: F.when(F.col("_parts") > 0, F.xxhash64(keys[0], part)).otherwise(F.col(keys[0])).alias("_key")
    left = dealt.select(*[c for c in big.columns if c != keys[0]], mixed(number))
    right = repeated.select(*small.columns, mixed(F.col("_part")))
    return left.join(right, "_key").drop("_key").select(*keys, *[c for c in big.columns if c not in keys], *[c for c in small.columns if c not in keys])


#: Columns of documents that operators know by name.
KNOWN = ("doc_id", "text", "lang", "source", "n_chars")


def guarded(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """docs with all but the known columns renamed by place, so that none clashes with an operator's own, and the names
    to give back by toDF at the end.
    """
    return docs.toDF(*[n if n in KNOWN else f"extra_{i}" for i, n in enumerate(docs.columns)]), docs.columns
