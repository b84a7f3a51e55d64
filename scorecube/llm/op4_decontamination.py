"""Benchmark decontamination by winnowing.

Of every 10 consecutive words the least of the six 5-word hashes is the fingerprint, so a text keeps few of its 5-word hashes
and yet any 10 words shared with an item have a fingerprint in common. An item with fewer words is one window, with the hash
of all its words as fingerprint; texts are searched for every such length that the benchmark has.

The items' fingerprints fill a Bloom filter of bounded size. One pass over the texts drops the fingerprints that it doesn't
hold; each other one is extended to the windows that it stands for, with their words. Those rows join the items' windows on
fingerprint and words, so a hit is exact, and a row per document comes back with the union of its hit windows. Item windows
are grouped before the join; a document without a candidate keeps one row, on a key of its own.

Words: A-Z lower-cased, runs of a-z, 0-9 and non-ASCII characters. Defined results: null or wordless texts and items have no
words and no hits; an item_id that is null makes hits but isn't listed; equal items or repeated item_ids count once; repeated
documents each give a row; an empty benchmark gives no hits, empty documents no rows; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bloom
from .common import ALNUM, LOWER, join_words, light, pieces, ranges, ready, rolling, window_starts, word_hashes, words

WINDOW = 10
GRAM = 5


def _fingerprints(hashes, at, length):
    """Of the windows of ``length`` words at each place of ``at``."""
    if length < WINDOW:
        return rolling(hashes, at, length, seed=length)
    grams = rolling(hashes, np.arange(max(len(hashes) - GRAM + 1, 0)), GRAM)
    low = grams[:len(grams) - WINDOW + GRAM].copy()
    for k in range(1, WINDOW - GRAM + 1):
        np.minimum(low, grams[k:k + len(low)], out=low)
    return low[at]


def _texts(data, start, end, at, length) -> list[bytes]:
    """The words of each window, joined by one space."""
    pick = ranges(at, np.full(len(at), length))
    raw, ends = join_words(data, start[pick], end[pick])
    raw, ends = raw.tobytes(), np.concatenate([[0], ends[length - 1::length]]).tolist()
    return [raw[a:b - 1] for a, b in zip(ends[:-1], ends[1:], strict=True)]


@light
def item_windows(batches):
    """Of (item, text): (item, length, fingerprint, words) for each window."""
    for batch in batches:
        for lo, _, data, offsets in pieces(batch["text"]):
            data = LOWER[data]
            start, end, first = words(data, offsets, ALNUM)
            h = word_hashes(data, start, end)
            n = np.diff(first)
            out: dict[str, list] = {"row": [], "length": [], "fingerprint": [], "words": []}
            for length in np.unique(np.minimum(n, WINDOW)).tolist():
                rows = np.flatnonzero(n >= WINDOW if length == WINDOW else n == length)
                if not length:
                    continue
                count = n[rows] - length + 1
                at = ranges(first[rows], count)
                out["row"] += (lo + np.repeat(rows, count)).tolist()
                out["length"] += [length] * len(at)
                out["fingerprint"].append(_fingerprints(h, at, length))
                out["words"] += _texts(data, start, end, at, length)
            prints = np.concatenate(out["fingerprint"] or [np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_pydict({
                "item": batch["item"].take(pa.array(out["row"], pa.int64())), "length": pa.array(out["length"], pa.int32()),
                "fingerprint": pa.array(prints.view(np.int64)), "words": pa.array(out["words"], pa.binary())})


def candidates(bits: np.ndarray, lengths: list[int]):
    """mapInArrow: text replaced by n_words and the windows whose fingerprint the filter passes."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("fingerprint", pa.int64()),
                               ("words", pa.binary())]))

    @light
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch["text"]):
                data = LOWER[data]
                start, end, first = words(data, offsets, ALNUM)
                h = word_hashes(data, start, end)
                found: list[list] = [[] for _ in range(hi - lo)]
                for length in lengths:
                    at = window_starts(first, length)
                    if not len(at):
                        continue
                    prints = _fingerprints(h, at, length)
                    # neighbouring windows mostly have one fingerprint: it's looked up once
                    new = np.concatenate([[True], prints[1:] != prints[:-1]])
                    hit = bloom.contains(bits, prints[new])[np.cumsum(new) - 1]
                    at, prints = at[hit], prints[hit].view(np.int64)
                    row = np.searchsorted(first, at, side="right") - 1
                    for r, s, p, w in zip(row.tolist(), (at - first[row]).tolist(), prints.tolist(),
                                          _texts(data, start, end, at, length) if len(at) else [], strict=True):
                        found[r].append({"start": s, "end": s + length, "fingerprint": p, "words": w})
                out = {c: batch[c].slice(lo, hi - lo) for c in batch.schema.names if c != "text"}
                out["n_words"] = pa.array(np.diff(first), pa.int64())
                out["found"] = pa.array(found, kind)
                yield pa.RecordBatch.from_pydict(out)
    return run


def _covered(spans: Column) -> Column:
    """Length of the union of (start, end) spans."""
    zero = F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total"))

    def add(so_far, span):
        fresh = span["end"] - F.greatest(so_far["end"], span["start"])
        return F.struct(F.greatest(so_far["end"], span["end"]).alias("end"),
                        (so_far["total"] + F.greatest(fresh, F.lit(0))).alias("total"))
    return F.aggregate(F.array_sort(spans), zero, add, lambda x: x["total"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(k, doc_id, n_words, n_hit, items, contaminated) for each row of ``docs`` (doc_id, text); items: sorted strings; k is the
    xxhash64 of doc_id and text."""
    ready(docs.sparkSession)
    items = (benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
             .mapInArrow(item_windows, "item string, length int, fingerprint bigint, words binary"))
    lengths = sorted(r["length"] for r in items.select("length").distinct().collect())  # ten at most
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(items.select(F.col("fingerprint").alias("k"))))
    grouped = items.groupBy("fingerprint", "words").agg(F.collect_set("item").alias("items"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).select(
        "doc_id", F.xxhash64("doc_id", "text").alias("k"), "text").mapInArrow(
        lambda batches: candidates(bits.value, lengths)(batches),
        f"doc_id {key_type}, k bigint, n_words bigint, "
        "found array<struct<start:bigint,end:bigint,fingerprint:bigint,words:binary>>")
    one = base.select("doc_id", "k", "n_words", F.posexplode_outer("found").alias("pos", "w"))
    one = one.select("doc_id", "k", "n_words", F.coalesce("pos", F.lit(0)).alias("pos"), "w.start", "w.end", "w.words",
                     F.coalesce("w.fingerprint", F.xxhash64("k")).alias("fingerprint"))
    hit = F.col("items").isNotNull()
    out = (one.join(grouped, ["fingerprint", "words"], "left").groupBy("doc_id", "k", "n_words")
           .agg(F.sum((F.col("pos") == 0).cast("int")).cast("int").alias("copies"),
                F.collect_list(F.when(hit, F.struct("start", "end"))).alias("spans"),
                F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
           .withColumn("n_hit", _covered(F.col("spans"))).withColumn("contaminated", F.col("n_hit") > 0))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
            .select("k", "doc_id", "n_words", "n_hit", "items", "contaminated"))


def op4_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contamination(read_table(spark, sf_dir, "documents", "doc_id", "text"),
                        read_table(spark, sf_dir, "benchmark", "item_id", "text"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                      F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of the benchmark occurs."""
    bad = contamination(docs, read_table(spark, sf_dir, "benchmark", "item_id", "text")).where("contaminated")
    bad = bad.select(F.col("k").alias("__k")).distinct()
    return docs.withColumn("__k", F.xxhash64("doc_id", "text")).join(bad, "__k", "left_anti").drop("__k")


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
items AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark),
placed AS (SELECT item, ws, least(len(ws), 10) AS m, unnest(range(1, greatest(len(ws) - 8, 2))) AS i
           FROM items WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(ws[i:i + m - 1], ' ') AS t FROM placed),
sizes AS (SELECT DISTINCT m FROM windows),
spread AS (SELECT rid, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM docs, sizes WHERE len(ws) >= m),
found AS (SELECT rid, i, m, array_to_string(ws[i:i + m - 1], ' ') AS t FROM spread),
hits AS (SELECT rid, i, m, item FROM found JOIN windows USING (m, t)),
covered AS (SELECT rid, count(DISTINCT at_word) AS n_hit
            FROM (SELECT rid, unnest(range(i, i + m)) AS at_word FROM hits) GROUP BY rid),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS t
           FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN covered USING (rid) LEFT JOIN listed USING (rid)"""
