"""Aggregates that a user writes as init, update, merge and finish.

Each task folds its rows into one state a key and hands on states, not rows. States of a key from many tasks meet in two steps, first
in a few parts, then as one, so that a key with most of the rows is never one task's work.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys whose states a task holds at a time, and parts in which states of a key meet first.
HELD, PARTS = 50_000, 16


def aggregate(
    df: DataFrame,
    keys: list[str],
    columns: list[str],
    init: Callable[[], Any],
    update: Callable[[Any, dict], Any],
    merge: Callable[[Any, Any], Any],
    finish: Callable[[Any], dict],
    out: dict[str, str],
) -> DataFrame:
    """``keys`` and the columns ``out`` (name to type) of each key.

    ``update(state, arrays)`` takes a run of a key's rows as numpy arrays by column, nulls as NaN or None; ``merge(a, b)`` joins two
    states in any order; ``finish(state)`` gives the row. States are pickled, and should be small.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)

    def rows(names: pa.Schema, states: dict[tuple, Any]) -> pa.RecordBatch:
        arrays = [pa.array([k[i] for k in states], names.field(c).type) for i, c in enumerate(keys)]
        return pa.RecordBatch.from_arrays([*arrays, pa.array([pickle.dumps(s) for s in states.values()], pa.binary())], [*keys, "state"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple, Any] = {}
        schema = None
        for b in batches:
            schema = b.schema
            frame = b.to_pandas()
            for key, index in frame.groupby(keys, dropna=False, sort=False).indices.items() if b.num_rows else ():
                first = int(index[0])
                key = tuple(b.column(c)[first].as_py() for c in keys)
                part = {c: frame[c].to_numpy()[index] for c in columns}
                states[key] = update(states[key] if key in states else init(), part)
            if len(states) > HELD:
                yield rows(schema, states)
                states = {}
        if states:
            yield rows(schema, states)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last, schema = None, None, None
        for b in batches:
            schema = b.schema
            for *key, raw in zip(*[b.column(c).to_pylist() for c in (*keys, "state")]):
                state = pickle.loads(raw)
                if key == last:
                    held = merge(held, state)
                    continue
                if last is not None:
                    yield rows(schema, {tuple(last): held})
                last, held = key, state
        if last is not None:
            yield rows(schema, {tuple(last): held})

    def done(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [finish(pickle.loads(x.as_py())) for x in b.column("state")]
            types = {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keys], *[pa.array([m[c] for m in made], types[t]) for c, t in out.items()]], [*keys, *out])

    states = df.select(*keys, *columns).mapInArrow(partial, f"{kinds}, state binary").withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(PARTS)))
    near = states.repartition(*keys, "_part").sortWithinPartitions("_part", *keys).drop("_part").mapInArrow(joined, f"{kinds}, state binary")
    whole = near.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(joined, f"{kinds}, state binary")
    return whole.mapInArrow(done, f"{kinds}, " + ", ".join(f"`{c}` {t}" for c, t in out.items()))
