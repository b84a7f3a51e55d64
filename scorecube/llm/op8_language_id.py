"""Language ID by language-bitmask n-gram filters.

An n-gram is four bytes in a row of the normalised text (A-Z lower-cased, every ASCII byte that is no letter a space,
a space on both sides), with two letters at least. Learning counts them for each language over all learning texts: tasks
combine their own counts, Spark adds them up. A language's Bloom filter gets the n-grams that make at least MIN_RATE of its
n-grams and at least SHARE of the rate in the language where they are the most frequent; so it holds 1 / MIN_RATE n-grams
at most, and the filters' size is bounded whatever the input. They are stored bit-sliced: a place has one bit for each language,
and the AND of an n-gram's places is the mask of all languages that contain it.

A text's score for a language is the population count of its bit over the text's n-grams, less what its filter passes in error:
(count - f * n) / (1 - f), f from the share of places set. The highest wins, ties to the first in the alphabet;
without evidence the language of most learned n-grams does. score is the winner's share of all positive scores (0 without
evidence).

Defined results: null texts and texts without a letter (Unicode) are `und`, score 0; so are all texts if nothing could be
learned; rows whose lang is null aren't learned from; every row gives a row, also for repeated or null doc_ids; an
empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import read_table
from .common import LOWER, byte_set, light, mix, pieces, ready, remainder

GRAM = 4
MIN_RATE = 1e-5
SHARE = 0.3
PLACES = 1 << 20
HASHES = 3

_LETTER = byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_NORMAL = np.where(_LETTER, LOWER, 32).astype(np.uint8)


def _grams(data, offsets):
    """(n-grams as integers, bounds: those of row r are bounds[r]:bounds[r + 1])."""
    rows = np.arange(len(offsets) - 1)
    text = np.full(len(data) + 2 * len(rows), 32, np.uint8)
    text[np.arange(len(data)) + 2 * np.repeat(rows, np.diff(offsets)) + 1] = _NORMAL[data]
    n = max(len(text) - GRAM + 1, 0)
    code, letters = np.zeros(n, np.uint32), np.zeros(n, np.uint8)
    for k in range(GRAM):
        code |= text[k:k + n].astype(np.uint32) << np.uint32(8 * k)
        letters += text[k:k + n] != 32
    edge = offsets + 2 * np.arange(len(offsets))  # a row's bytes with both spaces
    good = letters >= 2
    for k in range(1, GRAM):  # none across two rows
        at = edge[1:-1] - k
        good[at[(at >= 0) & (at < n)]] = False
    return code[good], np.searchsorted(np.flatnonzero(good), edge)


@light
def _count(batches):
    """Of (lang, text): (lang, gram, n), each pair once for the task."""
    langs: dict[str, int] = {}
    total = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

    def add(total, keys, counts):
        keys, inverse = np.unique(np.concatenate([total[0], keys]), return_inverse=True)
        sums = np.zeros(len(keys), np.int64)
        np.add.at(sums, inverse, np.concatenate([total[1], counts]))
        return keys, sums
    for batch in batches:
        number = np.array([langs.setdefault(x, len(langs)) for x in batch["lang"].to_pylist()], np.uint64)
        for lo, hi, data, offsets in pieces(batch["text"]):
            code, bounds = _grams(data, offsets)
            keys, counts = np.unique(code | np.repeat(number[lo:hi], np.diff(bounds)) << np.uint64(32), return_counts=True)
            total = add(total, keys, counts)
    names = np.array(list(langs), object)
    keys, sums = total
    yield pa.RecordBatch.from_pydict({
        "lang": pa.array(names[(keys >> np.uint64(32)).astype(np.int64)], pa.string()),
        "gram": pa.array((keys & np.uint64(0xFFFFFFFF)).astype(np.int64)), "n": pa.array(sums)})


def _places(code: np.ndarray) -> list[np.ndarray]:
    h = mix(code.astype(np.uint64), 51)
    return [((h >> np.uint64(20 * k)) % np.uint64(PLACES)).astype(np.int32) for k in range(HASHES)]


class Filters:
    """The bit-sliced filters: ``masks[place]`` has bit l set if the place is set in the filter of language l."""

    def __init__(self, langs: list[str], grams: list[np.ndarray], prior: int):
        self.langs, self.prior = langs, prior
        self.masks = np.zeros((max(1, -(-len(langs) // 64)), PLACES), np.uint64)
        self.errors = []
        for l, codes in enumerate(grams):
            own = np.zeros(PLACES, bool)
            for at in _places(codes):
                own[at] = True
            self.masks[l // 64] |= own.astype(np.uint64) << np.uint64(l % 64)
            self.errors.append(float(own.mean()) ** HASHES)

    def scores(self, code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Rows x languages: counts corrected for what the filters pass in error."""
        n = np.diff(bounds)
        out = np.zeros((len(n), len(self.langs)))
        places = _places(code)
        for word, masks in enumerate(self.masks):
            mask = masks[places[0]]
            for at in places[1:]:
                mask &= masks[at]
            for l in range(64 * word, min(len(self.langs), 64 * word + 64)):
                bit = (mask >> np.uint64(l % 64) & np.uint64(1)).astype(np.uint8)
                count = np.diff(np.concatenate([[0], np.cumsum(bit, dtype=np.int64)])[bounds])
                out[:, l] = np.maximum(0, (count - self.errors[l] * n) / (1 - self.errors[l]))
        return np.where(out < 1e-9, 0, out)


def learned(texts: DataFrame) -> Filters:
    """From (lang, text); rows with null lang are left out."""
    ready(texts.sparkSession)
    counts = (texts.where("lang IS NOT NULL").select("lang", F.col("text").cast("string").alias("text"))
              .mapInArrow(_count, "lang string, gram bigint, n bigint")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    rated = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    kept = (rated.withColumn("most", F.max("rate").over(Window.partitionBy("gram")))
            .where((F.col("rate") >= MIN_RATE) & (F.col("rate") >= SHARE * F.col("most"))).select("lang", "gram", "total"))
    by: dict[str, tuple[int, list[int]]] = {}
    for row in kept.collect():  # 1 / MIN_RATE rows for a language at most
        by.setdefault(row["lang"], (row["total"], []))[1].append(row["gram"])
    langs = sorted(by)
    prior = max(range(len(langs)), key=lambda l: (by[langs[l]][0], -l), default=0)
    return Filters(langs, [np.array(by[x][1], np.uint32) for x in langs], prior)


def _letter(data: np.ndarray) -> bool:
    return bool(_LETTER[data[data < 128]].any()) or any(c.isalpha() for c in data.tobytes().decode("utf-8", "replace"))


def identified(docs: DataFrame, filters: Filters) -> DataFrame:
    """All columns of ``docs`` but text, and lang_pred, score."""
    others = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @light
    def run(batches):
        f = shared.value
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch["text"]):
                scores = f.scores(*_grams(data, offsets))
                pred, best = [], []
                for r in range(hi - lo):
                    if not f.langs or not _letter(data[offsets[r]:offsets[r + 1]]):
                        pred.append("und")
                        best.append(0.0)
                        continue
                    total = float(scores[r].sum())
                    top = int(scores[r].argmax()) if total else f.prior
                    pred.append(f.langs[top])
                    best.append(float(scores[r, top]) / total if total else 0.0)
                out = {c: batch[c].slice(lo, hi - lo) for c in others}
                yield pa.RecordBatch.from_pydict(out | {"lang_pred": pa.array(pred, pa.string()),
                                                        "score": pa.array(best, pa.float64())})
    text = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
                       + ["lang_pred string", "score double"])
    return text.mapInArrow(run, schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held_out = remainder("doc_id") == 0
    filters = learned(docs.where(~held_out).select("lang", "text"))
    return identified(docs.select("doc_id", held_out.alias("held_out"), "text"), filters)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language is told; null texts and texts without a letter go."""
    filters = learned(docs.where(remainder("doc_id") != 0).select("lang", "text"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return identified(docs.select(row.alias("row"), "text"), filters).where("lang_pred <> 'und'").select("row.*")
