"""A Bloom filter of bounded size, filled by Spark tasks: a prefilter for values that a join then decides exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import mix

BITS = 1 << 24
_PART = 1 << 12


def places(key: np.ndarray) -> np.ndarray:
    return (np.stack([mix(key, s) for s in (41, 42, 43)]) % np.uint64(BITS)).astype(np.int64)


def build(keys: DataFrame) -> np.ndarray:
    """The filter (BITS / 8 bytes, whatever the input) of a frame's one long column, named ``k``: a task gives the parts it
    has set, Spark unites them."""
    def fill(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[places(batch["k"].to_numpy().view(np.uint64))] = True
        packed = np.packbits(bits).reshape(-1, _PART)
        some = np.flatnonzero(packed.any(axis=1))
        yield pa.RecordBatch.from_pydict({"part": pa.array(some, pa.int32()),
                                          "bits": pa.array([packed[i].tobytes() for i in some], pa.binary())})

    def unite(key, table):
        every = [np.frombuffer(x, np.uint8) for x in table["bits"].to_pylist()]
        return pa.table({"part": [key[0].as_py()], "bits": [np.bitwise_or.reduce(every).tobytes()]},
                        schema=pa.schema([("part", pa.int32()), ("bits", pa.binary())]))
    parts = keys.where("k IS NOT NULL").mapInArrow(fill, "part int, bits binary")
    packed = np.zeros((BITS // 8 // _PART, _PART), np.uint8)
    for row in parts.groupBy("part").applyInArrow(unite, "part int, bits binary").collect():  # BITS / 8 bytes
        packed[row["part"]] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return packed.reshape(-1)


def contains(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which keys the filter passes: all that it holds, and a few others."""
    out = np.ones(len(key), bool)
    for at in places(key):
        out &= (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
    return out
