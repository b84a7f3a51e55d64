"""Shared helpers: UTF-8 word splitting and Rabin-Karp hashing over Arrow buffers, sizing, row keys.

Python workers handle a text column as two arrays (bytes and row offsets), so that a word, a word's hash or a window's
hash is a vector operation over a whole piece of a batch; no loop runs over words. A piece is a run of whole rows of a
few MB, so memory doesn't follow the batch."""

from __future__ import annotations

import ctypes
import functools
import inspect
import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package

PIECE_BYTES = 2 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_WORD = (1 << 64) - 1


# ---- sizing ---------------------------------------------------------------------------------------------------------
def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files (or other leaves) that ``df`` reads, from Catalyst's statistics; starts no job."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    total = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return min(total, 1 << 50)  # a leaf without statistics reports the largest long


def splits(df: DataFrame, target: int, per_partition: int = 1) -> int:
    """How many parts of about ``target`` input bytes; at least ``per_partition`` for each shuffle partition. The count
    sets memory and parallelism only, never a result."""
    return max(per_partition * shuffle_partitions(df.sparkSession), math.ceil(input_bytes(df) / target), 1)


_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = str(64 << 20)


def ready(spark: SparkSession) -> None:
    """Python workers can import this package, and get Arrow batches of 8 MB unless the session says otherwise: a batch is held
    several times over outside the heap, and workers cut it into pieces of 2 MB anyway."""
    if spark.conf.get(_BATCH, _BATCH_DEFAULT).rstrip("b") == _BATCH_DEFAULT:
        spark.conf.set(_BATCH, "8m")
    ship_package(spark)


def remainder(col, by: int = 5):
    """crc32 of a key's decimal text modulo ``by``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(by)).cast("int")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Checkpointed in the cluster's shared folder (spark.checkpoint.dir)."""
    from ..session import shared_dir
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same cut by a Parquet table in the shared folder. A checkpoint keeps the size that the planner guessed for it, and
    guesses of joins multiply: in a loop of joins they outgrow the planner within some rounds. A table has its true size."""
    from ..session import shared_dir
    path = f"{shared_dir(df.sparkSession)}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# ---- what a worker process holds ------------------------------------------------------------------------------------
_HELD: dict = {}


def held(name, build: Callable):
    """The object ``name`` of this worker process, built by the first of its tasks that asks; one is held at most."""
    if name not in _HELD:
        _HELD.clear()
        _HELD[name] = build()
    return _HELD[name]


def _give_back() -> None:
    """Freed memory returns to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def light(run):
    """A mapInArrow function that needs no ``held`` object. Spark uses a worker again for later stages, so what another
    operator's tasks have left there goes first; when the task ends, freed memory returns to the system."""
    @functools.wraps(run)
    def task(batches):
        _HELD.clear()
        yield from run(batches)
        _give_back()
    return task


def light_group(run):
    """The same for a function of whole groups (applyInArrow), after each group: one group's arrays needn't lie beside the
    next one's."""
    @functools.wraps(run)
    def group(*tables):
        _HELD.clear()
        out = run(*tables)
        _give_back()
        return out
    # Spark tells functions of a key and a table from those of a table by their parameters
    group.__signature__ = inspect.signature(run)
    return group


# ---- text as arrays -------------------------------------------------------------------------------------------------
def utf8(col) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if col.null_count:
        col = pc.fill_null(col, "" if pa.types.is_string(col.type) or pa.types.is_large_string(col.type) else b"")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    _, offs, raw = col.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0]:offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def pieces(col, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole rows; a longer row is a piece of its own."""
    data, offsets = utf8(col)
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi, data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo]
        lo = hi


def byte_set(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, bool)
    for a, b in ranges:
        out[a:b + 1] = True
    return out


NOT_SPACE = ~byte_set((0x09, 0x0D), (0x20, 0x20))
#: letters a-z, digits and everything outside ASCII
ALNUM = byte_set((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, allowed: np.ndarray):
    """(start, end, first): byte bounds of each maximal run of allowed bytes inside a row; ``first[r]:first[r+1]`` are
    the words of row r."""
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = allowed[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, offsets)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values (splitmix finaliser)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & _WORD)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_TABLE = mix(np.arange(256, dtype=np.uint64), 7)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2^64."""
    got = _POWERS.get(base)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.cumprod(p))
        got = (out[0], out[1])
        if size <= 8 << 20:
            _POWERS[base] = got
    return got


def _spans(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial (Rabin-Karp) hash of values[start:end], the same at every place, from one running sum."""
    up, down = _powers(len(values) + 1, base)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[:len(values)], out=total[1:])
    return (total[end] - total[start]) * up[start]


def word_hashes(data, start, end, seed: int = 0) -> np.ndarray:
    h = _spans(_TABLE[data], start, end, _BASE)
    return mix(h ^ mix((end - start).astype(np.uint64), 3), seed)


def rolling(hashes: np.ndarray, at: np.ndarray, k, seed: int = 0) -> np.ndarray:
    """Rabin-Karp hash of the k words from each place of ``at``."""
    base = (_BASE * (2 * seed + 3)) & _WORD | 5
    return mix(_spans(hashes if seed == 0 else mix(hashes, seed), at, at + k, base | 1), seed)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(count)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - count), count)


def window_starts(first: np.ndarray, k: int) -> np.ndarray:
    """Places at which k words of one row begin."""
    return ranges(first[:-1], np.maximum(np.diff(first) - k + 1, 0))


def join_words(data, start, end) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, ends): the given words, each followed by one space."""
    length = end - start + 1
    ends = np.cumsum(length)
    if not len(ends):
        return np.zeros(0, np.uint8), ends
    out = data[np.minimum(ranges(start, length), len(data) - 1)]
    out[ends - 1] = 32
    return out, ends
