"""Partial results keyed by a pair of blocks, merged in streams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results of a block pair are merged in this many streams first.
STREAMS = 16
STATE = "a int, b int, state binary"


def state_batch(a: int, b: int, state: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([np.ascontiguousarray(state).tobytes()], pa.binary())],
        names=["a", "b", "state"])


def fold(parts: DataFrame, merge, finish, schema: str) -> DataFrame:
    """Merge the partial results ``(a, b, state)`` of every key (a, b).

    Two passes, the first salted; in both a task reads its keys in order and
    holds one state at a time, however many partial results a key has."""

    def stream(batches):
        key, held = None, None
        for batch in batches:
            for k, raw in zip(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()), batch.column("state")):
                state = np.frombuffer(raw.as_buffer(), np.float64)
                if k == key:
                    held = merge(held, state)
                    continue
                if key is not None:
                    yield key, held
                key, held = k, state
        if key is not None:
            yield key, held

    def halfway(batches):
        for (a, b), state in stream(batches):
            yield state_batch(a, b, state)

    def whole(batches):
        for (a, b), state in stream(batches):
            yield from finish(a, b, state)

    salted = parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(STREAMS)))
    some = salted.repartition("a", "b", "salt").sortWithinPartitions("a", "b", "salt").drop("salt").mapInArrow(halfway, STATE)
    return some.repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(whole, schema)
