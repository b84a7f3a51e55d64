"""Quality classifier: ridge regression on random Fourier features of document statistics, calibrated by isotonic regression.

1. One pass over the texts turns each into STATISTICS numbers (shares of kinds of bytes, word and line lengths, how much repeats).
   Those rows, without texts, are written once and used by all that follows.
2. Standardised with the learning rows' means and deviations, they are mapped to FEATURES random Fourier features, whose inner
   products approximate a Gaussian kernel. Each task sums its rows' normal equations; Spark adds up the tasks' sums a row of the
   matrix at a time; the driver solves the FEATURES + 1 equations.
3. Scores of the learning rows are counted in BINS bins by label; pool-adjacent-violators gives the rising calibration curve.

All labelled learning rows are used, none sampled. Every size that the driver sees depends on the parameters alone.

Defined results: null and empty texts have the statistics 0; labels that are null or not 0 or 1, or without a document, are not
learned from; a label given twice counts twice; without learning rows, or with one class only, the score is that class's share
(0.5 without any); every row gives a row, also for repeated or null doc_ids (a null one is never labelled); an empty table gives an
empty result; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import NOT_SPACE, cut_lineage, pieces, ready, remainder, rolling, window_starts, word_hashes, words

FEATURES = 256
RIDGE = 1e-3
BINS = 2048
PREDICT = 0.3

#: kinds of bytes: 0 a-z, 1 A-Z, 2 digit, 3 space, 4 line end, 5 non-ASCII, 6 . and ,  7 ! and ?  8 |  9 other ASCII
_KIND = np.full(256, 9, np.uint8)
for _kind, _bytes in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\r\n",
                                bytes(range(128, 256)), b".,", b"!?", b"|")):
    _KIND[list(_bytes)] = _kind
_KINDS = 10
STATISTICS = _KINDS + 13


def _ratio(a, b):
    return np.divide(a, b, out=np.zeros(len(b), np.float64), where=b > 0)


def _by_row(first, values):
    """Sums of values between the bounds ``first``."""
    return np.diff(np.concatenate([[0], np.cumsum(values)])[first])


def _distinct(first, values):
    """How many different values each row has."""
    rows = np.repeat(np.arange(len(first) - 1), np.diff(first))
    order = np.lexsort((values, rows))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (rows[order][1:] != rows[order][:-1])
    return np.bincount(rows[order][new], minlength=len(first) - 1)


def _pieces_of(data, offsets, allowed):
    start, end, first = words(data, offsets, allowed)
    return start, end, first, word_hashes(data, start, end)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x STATISTICS."""
    rows, size = len(offsets) - 1, np.diff(offsets)
    kind = _KIND[data]
    counts = np.bincount(np.repeat(np.arange(rows) * _KINDS, size) + kind, minlength=rows * _KINDS).reshape(rows, _KINDS)
    start, end, first, h = _pieces_of(data, offsets, NOT_SPACE)
    n, length = np.diff(first).astype(np.float64), (end - start).astype(np.float64)
    capital = (kind == 1)[start] if len(start) else np.zeros(0, bool)
    last = kind[end - 1] if len(end) else np.zeros(0, np.uint8)
    same = np.zeros(len(h))
    same[1:] = h[1:] == h[:-1]
    same[first[:-1][n > 0]] = 0
    mean = _ratio(_by_row(first, length), n)
    out = [_ratio(counts[:, k], size) for k in range(_KINDS)]
    out += [np.log1p(size), np.log1p(n), mean, np.sqrt(np.maximum(0, _ratio(_by_row(first, length ** 2), n) - mean ** 2)),
            _ratio(_by_row(first, same), n), _ratio(_distinct(first, h), n),
            _ratio(_by_row(first, capital), n), _ratio(_by_row(first, last >= 7), n), _ratio(_by_row(first, length <= 3), n)]
    at = window_starts(first, 3)
    threes = np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - 2, 0))])
    out.append(_ratio(_distinct(threes, rolling(h, at, 3)), np.diff(threes)))
    for ends in (_KIND != 4, (_KIND != 4) & (np.arange(256) != ord("."))):
        _, _, of_lines, lines = _pieces_of(data, offsets, ends)
        out.append(_ratio(_distinct(of_lines, lines), np.diff(of_lines)))
    out.append(np.log1p(_ratio(n, np.diff(of_lines))))
    return np.stack(out, axis=1)


def _statistics_of(batches):
    for batch in batches:
        for lo, hi, data, offsets in pieces(batch["text"]):
            out = {c: batch[c].slice(lo, hi - lo) for c in batch.schema.names if c != "text"}
            yield pa.RecordBatch.from_pydict(out | {"x": pa.array(list(statistics(data, offsets)), pa.list_(pa.float64()))})


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Model:
    """Everything a task needs to score rows of statistics; its size is set by the parameters."""

    def __init__(self, mean: np.ndarray, deviation: np.ndarray, features: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.mean, self.deviation = mean, np.where(deviation > 1e-9, deviation, 1.0)
        self.turn = rng.standard_normal((len(mean), features)) / np.sqrt(len(mean))
        self.shift = rng.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.curve = (np.zeros(1), np.full(1, 0.5))

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.deviation, -8, 8)
        return np.hstack([np.cos(z @ self.turn + self.shift) * np.sqrt(2 / len(self.shift)), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights if len(x) else np.zeros(0)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), *self.curve), 0, 1)


def normal_equations(model: Model):
    """mapInArrow: of (x, y), a row (i, values) for each row of the task's sum of z z' with z y as last column."""
    def run(batches):
        width = len(model.weights)
        total = np.zeros((width, width + 1))
        for batch in batches:
            if len(batch):
                z = model.mapped(_matrix(batch["x"]))
                total += z.T @ np.hstack([z, batch["y"].to_numpy().astype(np.float64)[:, None]])
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(width), pa.int32()),
                                          "v": pa.array(list(total), pa.list_(pa.float64()))})
    return run


def _summed(key, table):
    total = _matrix(table["v"].combine_chunks()).sum(axis=0)
    return pa.table({"i": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total], pa.list_(pa.float64()))})


def isotonic(place: np.ndarray, weight: np.ndarray, positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins in rising order: the weighted middle and the share of each pool."""
    pools: list[list[float]] = []
    for p, w, y in zip(place, weight, positive, strict=True):
        pools.append([p * w, w, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p / w for p, w, _ in pools]), np.array([y / w for _, w, y in pools])


def fitted(learning: DataFrame, features: int = FEATURES) -> Model:
    """From rows (x, y)."""
    at = learning.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(
        F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation")).orderBy("i").collect()  # STATISTICS rows
    model = Model(np.array([r["mean"] for r in at] or [0.0] * STATISTICS),
                  np.array([r["deviation"] for r in at] or [1.0] * STATISTICS), features)
    if not at:
        return model
    rows = (learning.mapInArrow(normal_equations(model), "i int, v array<double>")
            .groupBy("i").applyInArrow(_summed, "i int, v array<double>").collect())  # FEATURES + 1 rows
    total = np.array([r["v"] for r in sorted(rows, key=lambda r: r["i"])])
    n = total[-1, -2]
    model.weights = np.linalg.solve(total[:, :-1] + RIDGE * n / features * np.eye(len(total)), total[:, -1])

    def binned(batches):
        for batch in batches:
            raw = model.raw(_matrix(batch["x"])) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({"bin": pa.array(np.clip((raw + 0.5) * BINS / 2, 0, BINS - 1).astype(np.int32)),
                                              "y": batch["y"].cast(pa.int32())})
    bins = (learning.mapInArrow(binned, "bin int, y int").groupBy("bin")
            .agg(F.count("*").alias("n"), F.sum("y").alias("positive")).orderBy("bin").collect())  # BINS rows at most
    model.curve = isotonic(np.array([(r["bin"] + 0.5) * 2 / BINS - 0.5 for r in bins]),
                           np.array([r["n"] for r in bins], float), np.array([r["positive"] for r in bins], float))
    return model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for rows (doc_id, text); labels (doc_id, quality) of held-out rows are not used."""
    ready(docs.sparkSession)
    key = docs.schema["doc_id"].dataType.simpleString()
    rows = cut_lineage(docs.select("doc_id", F.col("text").cast("string").alias("text"))
                       .mapInArrow(_statistics_of, f"doc_id {key}, x array<double>"))
    held_out = remainder("doc_id") == 0
    marks = labels.where("quality IN (0, 1)").select("doc_id", F.col("quality").cast("int").alias("y"))
    model = fitted(cut_lineage(rows.where(~held_out).join(marks, "doc_id").select("x", "y")))

    def run(batches):
        for batch in batches:
            score = model.score(_matrix(batch["x"])) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": pa.array(score, pa.float64()),
                "predicted": pa.array((score >= PREDICT).astype(np.int32))})
    return rows.select("doc_id", held_out.alias("held_out"), "x").mapInArrow(
        run, f"doc_id {key}, held_out boolean, score double, predicted int")


def op2_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                  read_table(spark, sf_dir, "labels", "doc_id", "quality"))
