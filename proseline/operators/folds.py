"""Folds over ordered rows of a key, as streams of sorted partitions: a task holds a fold's state and not its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Fold(Protocol):
    """The state of one key: what it gives out for each row and at the end, as tuples of the output's columns."""

    def add(self, row: tuple) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def fold(df: DataFrame, by: str, order: list[str], columns: list[str], start: Callable[[object], Fold], out: StructType, rows: int = 4096) -> DataFrame:
    """start(key) makes the fold of a key; it is given the columns of the key's rows in order, one row at a time.

    Keys are dealt to partitions by hash and pass one after another; equal places in the order are taken as they come.
    """
    schema = to_arrow_schema(out)

    def run(batches):
        current, state, done = None, None, []

        def packed() -> pa.RecordBatch:
            values = zip(*done, strict=True) if done else [()] * len(schema)
            found = pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(values, schema, strict=True)], schema=schema)
            done.clear()
            return found

        for batch in batches:
            for key, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if state is None or key != current:
                    if state is not None:
                        done.extend(state.end())
                    current, state = key, start(key)
                done.extend(state.add(tuple(row)))
                if len(done) >= rows:
                    yield packed()
        if state is not None:
            done.extend(state.end())
        yield packed()

    dealt = df.select(by, *[c for c in dict.fromkeys([*order, *columns]) if c != by]).repartition(by)
    return dealt.sortWithinPartitions(by, *order).select(by, *columns).mapInArrow(run, out)
