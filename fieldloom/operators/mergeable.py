"""User-written aggregates for keys of any size.

An aggregate is four functions on a state that the user chooses: ``start`` makes an empty one, ``update`` takes in some
rows of one key, ``merge`` puts two states together, the earlier rows first, and ``finish`` makes the result row. Every
batch updates the states of its keys where its rows are; only states are shuffled. They meet in two levels, first
neighbouring partitions of a key, then the rest, and are merged one by one as they stream by. So neither the rows nor
the states of a key are ever together in one place, and a key with a third of the table costs its share like any other.

With ``order`` the rows are range-partitioned on (keys, order) first and every merge is of neighbouring ranges, so an
aggregate may depend on the order of its rows: ranks, runs, first differences, Gini.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StructField, StructType, _parse_datatype_string

from fieldloom.operators.scale import same_keys

#: keys that a task holds states of before it hands them on; this only bounds its memory
HELD = 20_000
#: neighbouring partitions whose states of a key meet first
FAN = 64


@dataclass(frozen=True)
class Aggregate:
    """``update`` gets a pandas frame of rows of one key; states must be small and picklable; merging is associative."""

    start: Callable[[], Any]
    update: Callable[[Any, pd.DataFrame], Any]
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], Sequence[Any]]


def _same(key: tuple) -> tuple:
    """A key whose NaN equals itself."""
    return tuple("nan" if isinstance(v, float) and v != v else v for v in key)


def _keys_of(batch: pa.RecordBatch, n: int) -> list[tuple]:
    return list(zip(*[batch.column(i).to_pylist() for i in range(n)], strict=True)) if n else [()] * batch.num_rows


def _slices(batch: pa.RecordBatch, n: int) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """(key, its rows in their order) for every key of the batch; the keys are its first ``n`` columns."""
    if not batch.num_rows:
        return
    if not n:
        yield (), batch.to_pandas()
        return
    names = [f"k{i}" for i in range(n)]
    table = pa.table([batch.column(i) for i in range(n)] + [pa.array(np.arange(batch.num_rows))], names=[*names, "row"])
    groups = table.group_by(names, use_threads=False).aggregate([("row", "list")])
    rows = groups.column("row_list").combine_chunks()
    values = batch.select(list(range(n, batch.num_columns))).take(rows.flatten()).to_pandas()
    ends = np.asarray(rows.offsets) - int(rows.offsets[0].as_py())
    keys = zip(*[groups.column(c).to_pylist() for c in names], strict=True)
    for key, a, b in zip(keys, ends.tolist(), ends[1:].tolist(), strict=False):
        yield key, values.iloc[a:b]


def aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], agg: Aggregate, returns: str, order: Sequence[str] = ()) -> DataFrame:
    """A row for each key: the keys and the columns ``returns`` (as DDL) of ``agg`` over ``values``.

    Null and NaN are keys like all others; without keys there is one row, or none for an empty table. ``order`` names
    columns (also among ``values`` if the functions read them) along which rows come and states are merged; rows that
    tie in it come in any order. Otherwise states are merged in any order.
    """
    keys, values = list(keys), list(values)
    spark_keys = StructType([df.schema[k] for k in keys])
    states = StructType([*spark_keys, StructField("_chunk", LongType()), StructField("_state", BinaryType())])
    arrow, key_types = to_arrow_schema(states), to_arrow_schema(spark_keys)
    result = StructType([*spark_keys, *_parse_datatype_string(returns)])
    result_arrow = to_arrow_schema(result)
    n = len(keys)

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found, strict=True)) or [[] for _ in arrow]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId() << 32
        held: dict[tuple, tuple[tuple, Any]] = {}
        handed = 0
        for batch in batches:
            for key, rows in _slices(batch, n):
                same = _same(key)
                state = held[same][1] if same in held else agg.start()
                held[same] = (key, agg.update(state, rows))
            if len(held) > HELD:
                yield rows_of([(*k, task + handed, pickle.dumps(s)) for k, s in held.values()])
                held, handed = {}, handed + 1
        yield rows_of([(*k, task + handed, pickle.dumps(s)) for k, s in held.values()])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int, Any]]:
        """States of neighbouring rows with one key, merged as they come."""
        now, at, state = None, 0, None
        for batch in batches:
            chunks, packed = batch.column("_chunk").to_pylist(), batch.column("_state").to_pylist()
            for key, chunk, data in zip(_keys_of(batch, n), chunks, packed, strict=True):
                group = (_same(key), chunk // (FAN << 32))
                if now is not None and now[0] == group:
                    state = agg.merge(state, pickle.loads(data))
                    continue
                if now is not None:
                    yield now[1], at, state
                now, at, state = (group, key), chunk, pickle.loads(data)
        if now is not None:
            yield now[1], at, state

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for key, chunk, state in met(batches):
            out.append((*key, chunk, pickle.dumps(state)))
            if len(out) >= HELD:
                yield rows_of(out)
                out = []
        yield rows_of(out)

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []

        def done() -> tuple:
            return (*now, *agg.finish(state))

        for batch in batches:
            for key, data in zip(_keys_of(batch, n), batch.column("_state").to_pylist(), strict=True):
                if now is not None and _same(now) == _same(key):
                    state = agg.merge(state, pickle.loads(data))
                    continue
                if now is not None:
                    out.append(done())
                now, state = key, pickle.loads(data)
            if len(out) >= HELD:
                yield _rows(out, result_arrow)
                out = []
        if now is not None:
            out.append(done())
        yield _rows(out, result_arrow)

    slim = df.select(*keys, *values, *[F.col(c).alias(f"_order{i}") for i, c in enumerate(order)])
    if order:
        along = [F.col(k) for k in keys] + [F.col(f"_order{i}") for i in range(len(order))]
        slim = slim.repartitionByRange(*along).sortWithinPartitions(*along)
    parts = slim.select(*keys, *values).mapInArrow(partial, states)
    near = F.floor(F.col("_chunk") / F.lit(FAN << 32))
    first = parts.repartition(*keys, near).sortWithinPartitions(*keys, "_chunk").mapInArrow(joined, states)
    last = (first.repartition(*keys) if keys else first.coalesce(1)).sortWithinPartitions(*keys, "_chunk")
    return last.mapInArrow(finished, result)


def _rows(found: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def fit_apply(
    df: DataFrame, keys: Sequence[str], values: Sequence[str], agg: Aggregate, fit: str,
    fn: Callable[[tuple, tuple, pd.DataFrame], pd.DataFrame], schema: str, order: Sequence[str] = (),
) -> DataFrame:
    """User function on all rows of every key, for keys of any size.

    ``fn(key, fitted, rows)`` gets a key, what ``agg`` (columns ``fit`` as DDL) made of all its rows, and some of its rows,
    and gives rows of ``schema``. It is called once for each key of a batch, so many times for a large key.
    """
    keys, names = list(keys), _parse_datatype_string(fit).names
    fitted = aggregate(df, keys, values, agg, fit, order).withColumnsRenamed({c: f"_fit_{c}" for c in names})
    rows = same_keys(df, fitted, keys)
    first = [df.columns.index(k) for k in keys]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.num_columns - len(names)
            by_key = batch.select([*first, *range(batch.num_columns)])
            for key, part in _slices(by_key, len(keys)):
                told = tuple(part.iloc[0, own:])
                yield from pa.Table.from_pandas(fn(key, told, part.iloc[:, :own]), arrow_schema, preserve_index=False).to_batches()

    arrow_schema = to_arrow_schema(_parse_datatype_string(schema))
    return rows.mapInArrow(apply, schema)
