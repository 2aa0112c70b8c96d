"""Runs a step function over each group of a table: the one Python stage for operators that carry state from row to row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from gridmark.session import ship


def plain(value: object) -> object:
    """A pandas cell as a plain Python value, null as None."""
    if isinstance(value, (list, tuple)) or hasattr(value, "tolist") and getattr(value, "ndim", 0):
        return [plain(v) for v in value]
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def batch(df: DataFrame, keys: list[str], order: list[str], machine: Callable[[dict], object], schema: str, params: list[str] | None = None) -> DataFrame:
    """The outputs of ``machine(params).step`` over each group of ``keys`` in ``order``, with the keys.

    ``machine`` gets a dict of the group's ``params`` columns.  Rows stream through a partition sorted by keys, so a task holds one batch of rows and
    one state at a time, however long a group is.  Null keys are a group; rows of equal order keep their order of ``order`` alone.
    """
    ship(df.sparkSession)
    params = params or []
    fields = StructType.fromDDL(schema)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out_schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    names = [*keys, *[f.name for f in fields]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for b in batches:
            out = []
            columns = list(b.columns)
            for values in b.itertuples(index=False, name=None):
                row = {c: plain(v) for c, v in zip(columns, values, strict=True)}
                now = tuple(row[k] for k in keys)
                if state is None or now != key:
                    if state is not None:
                        out += [(*key, *[o.get(f.name) for f in fields]) for o in state.end()]
                    key, state = now, machine({p: row[p] for p in params})
                out += [(*key, *[o.get(f.name) for f in fields]) for o in state.step(row)]
            if out:
                yield pd.DataFrame(out, columns=names, dtype=object)
        if state is not None and (rest := state.end()):
            yield pd.DataFrame([(*key, *[o.get(f.name) for f in fields]) for o in rest], columns=names, dtype=object)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, out_schema)


def along(df: DataFrame, keys: list[str], order: list[str | Column], reads: list[str], machine: Callable[[], object], schema: str) -> DataFrame:
    """``df`` with the columns of ``schema``: what ``machine().step(*values of reads)`` returns, as a tuple, for each row of a group of ``keys`` in ``order``.

    Rows pass through as Arrow batches and keep their types; a task holds one batch and one state at a time.  Null keys are a group.
    """
    ship(df.sparkSession)
    more = StructType.fromDDL(schema)
    kinds = [to_arrow_type(f.dataType) for f in more]
    out_schema = StructType([*df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            read = lambda names: zip(*[b.column(n).to_pylist() for n in names], strict=True)  # noqa: B023, E731
            out = []
            for now, row in zip(read(keys), read(reads), strict=True):
                if state is None or now != key:
                    key, state = now, machine()
                out.append(state.step(*row))
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], [*b.schema.names, *more.names])

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, out_schema)


def groups(df: DataFrame, keys: list[str], order: list[str | Column], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work(rows, starts)`` yields for whole groups of ``keys`` in ``order``: many small ones together, a large one by itself.  A task holds a group and a batch."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            if held[0].select(keys).slice(0, 1).to_pylist() == b.select(keys).slice(b.num_rows - 1).to_pylist():
                continue  # the group may go on
            rows = pa.Table.from_batches(held).combine_chunks()
            starts = np.flatnonzero(changes(*[codes(rows.column(k)) for k in keys]))
            if len(starts) > 1:
                yield from work(rows.slice(0, starts[-1]), starts[:-1])
            held = rows.slice(starts[-1]).to_batches()
        if held:
            yield from work(pa.Table.from_batches(held).combine_chunks(), np.zeros(1, np.int64))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal numbers for equal values; null is a value."""
    return column.combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before, and the first row."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def swept(df: DataFrame, name: str, values: list[float]) -> DataFrame:
    """Each row once for each parameter value, in the column ``name``: with it as a further key one job runs the whole sweep."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(float(v)) for v in values])))
