"""Substring dedup: Rabin-Karp hashes of every fixed-length token window, counted in Spark; repeated windows merge into
maximal removal intervals.

Texts are dealt into chunks by doc_id. A chunk hashes all its windows, keeps each hash once (a passage that fills a
chunk is one value), and sends every hash bucket one packed list. A bucket finds the hashes that two chunks have and
answers each chunk with one bit for each value it sent. A chunk that meets its own texts again (the same exchange, reused)
then knows each window that starts anywhere else, and covers its words. No shuffle carries a row for a window, and the
copies of one passage reach a bucket once for each chunk, however many they are.

A hash is 56 bits of one polynomial hash beside the bucket number from another one, so its strength grows with the
number of buckets. Words: runs of bytes other than space and 09-0D.

Defined results: null or empty text has no words; a text shorter than the window is kept; every row is a document, also
if its doc_id is null or repeated (then equal texts repeat each other); an empty table gives an empty result; other
columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import NOT_SPACE, join_words, light_group, pieces, ready, rolling, splits, window_starts, word_hashes, words

WINDOW = 35
CHUNK_BYTES = 8 << 20
BUCKET_BYTES = 16 << 20
KEY_BYTES = 7


def _windows(table: pa.Table, window: int):
    """Of a chunk: per piece (first row, bytes, word bounds, first words, window starts), and the two hashes."""
    parts, one, two = [], [], []
    for lo, _, data, offsets in pieces(table["text"]):
        start, end, first = words(data, offsets, NOT_SPACE)
        at = window_starts(first, window)
        parts.append((lo, data, start, end, first, at))
        if len(at):
            h = word_hashes(data, start, end)
            one.append(rolling(h, at, window) >> np.uint64(8))
            two.append(rolling(h, at, window, seed=1))
    none = np.zeros(0, np.uint64)
    return parts, np.concatenate(one or [none]), np.concatenate(two or [none])


def _by_bucket(two: np.ndarray, buckets: int):
    """(order, bounds): windows in the order of their bucket."""
    bucket = (two % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def send(window: int, buckets: int):
    @light_group
    def run(key, table):
        _, one, two = _windows(table, window)
        order, bounds = _by_bucket(two, buckets)
        one = one[order]
        out: dict[str, list] = {"bucket": [], "chunk": [], "hashes": []}
        for b in np.flatnonzero(np.diff(bounds)):
            values = np.unique(one[bounds[b]:bounds[b + 1]])
            out["bucket"].append(int(b))
            out["chunk"].append(key[0].as_py())
            out["hashes"].append(values.view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes())
        return pa.table(out, schema=pa.schema([("bucket", pa.int32()), ("chunk", pa.int32()), ("hashes", pa.binary())]))
    return run


@light_group
def answer(key, table):
    """For each chunk's list of a bucket: which values another chunk has too (one bit each)."""
    blobs = table["hashes"].to_pylist()
    sizes = np.array([len(x) // KEY_BYTES for x in blobs])
    wide = np.zeros((int(sizes.sum()), 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(b"".join(blobs), np.uint8).reshape(-1, KEY_BYTES)
    values = wide.reshape(-1).view(np.uint64)
    ranked = np.sort(values)
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    out: dict[str, list] = {"chunk": [], "bucket": [], "bits": []}
    if len(twice):
        place = np.searchsorted(twice, values)
        hit = twice[np.minimum(place, len(twice) - 1)] == values
        for chunk, bits in zip(table["chunk"].to_pylist(), np.split(hit, np.cumsum(sizes)[:-1]), strict=True):
            if bits.any():
                out["chunk"].append(chunk)
                out["bucket"].append(key[0].as_py())
                out["bits"].append(np.packbits(bits).tobytes())
    return pa.table(out, schema=pa.schema([("chunk", pa.int32()), ("bucket", pa.int32()), ("bits", pa.binary())]))


SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _resolve_piece(piece, again: np.ndarray, window: int):
    """(words, words removed, removal intervals in word numbers, kept text) of each row of a piece."""
    _, data, start, end, first, at = piece
    edge = np.zeros(len(start) + 1, np.int64)
    edge[at[again]] += 1
    edge[at[again] + window] -= 1
    gone = np.cumsum(edge)[:len(start)] > 0
    out, ends = join_words(data, start[~gone], end[~gone])
    raw, ends = out.tobytes(), np.concatenate([[0], ends])
    kept = np.concatenate([[0], np.cumsum(~gone)])[first]
    for r in range(len(first) - 1):
        a, b, n = first[r], first[r + 1], kept[r + 1] - kept[r]
        spans = []
        if n < b - a:
            steps = np.flatnonzero(np.diff(np.concatenate([[0], gone[a:b].view(np.int8), [0]])))
            spans = [{"start": x, "end": y} for x, y in steps.reshape(-1, 2).tolist()]
        yield int(b - a), int(b - a - n), spans, raw[ends[kept[r]]:ends[kept[r + 1]] - 1] if n else b""


def resolve(window: int, buckets: int, rewrite: bool):
    @light_group
    def run(docs, bits):
        parts, one, two = _windows(docs, window)
        order, bounds = _by_bucket(two, buckets)
        replies = dict(zip(bits["bucket"].to_pylist(), bits["bits"].to_pylist(), strict=True))
        again = np.zeros(len(one), bool)
        for b in np.flatnonzero(np.diff(bounds)):
            own = order[bounds[b]:bounds[b + 1]]
            values, inverse, counts = np.unique(one[own], return_inverse=True, return_counts=True)
            twice = counts > 1
            if b in replies:
                twice |= np.unpackbits(np.frombuffer(replies[b], np.uint8), count=len(values)).astype(bool)
            again[own] = twice[inverse]
        rows, done = [], 0
        for piece in parts:
            rows += _resolve_piece(piece, again[done:done + len(piece[-1])], window)
            done += len(piece[-1])
        out = {c: docs[c] for c in docs.column_names if c not in ("chunk", "text")}
        out["n_words"] = pa.array([x[0] for x in rows], pa.int64())
        out["n_removed"] = pa.array([x[1] for x in rows], pa.int64())
        out["removed"] = pa.array([x[2] for x in rows], SPANS)
        if rewrite:
            cut = pa.array([x[3] if x[1] else None for x in rows], pa.binary()).cast(pa.string())
            out["text"] = pc.coalesce(cut, docs["text"].combine_chunks().cast(pa.string()))
        else:
            out["kept_sha256"] = pa.array([hashlib.sha256(x[3]).hexdigest() for x in rows], pa.string())
        return pa.table(out)
    return run


def removals(docs: DataFrame, window: int = WINDOW, rewrite: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, removed (maximal intervals of word numbers, end exclusive), and
    kept_sha256 (of the kept words joined by one space). With ``rewrite`` instead all columns of ``docs``, text holding the
    kept words where any was removed, beside the three counts and intervals in a column ``removal``."""
    ready(docs.sparkSession)
    chunks, buckets = splits(docs, CHUNK_BYTES, 2), splits(docs, BUCKET_BYTES)
    others = [c for c in docs.columns if c not in ("doc_id", "text")] if rewrite else []
    # unequal texts of one doc_id, and null ones, go to different chunks
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    dealt = docs.select(chunk.alias("chunk"), "doc_id", F.col("text").cast("string").alias("text"),
                        *[F.struct(*[F.col(f"`{c}`") for c in others]).alias("row")][:len(others)])
    bits = (dealt.groupBy("chunk").applyInArrow(send(window, buckets), "bucket int, chunk int, hashes binary")
            .groupBy("bucket").applyInArrow(answer, "chunk int, bucket int, bits binary"))
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields if f.name in ("doc_id", "row")]
                       + ["n_words bigint", "n_removed bigint", "removed array<struct<start:bigint,end:bigint>>",
                          "text string" if rewrite else "kept_sha256 string"])
    out = (dealt.groupBy("chunk").cogroup(bits.groupBy("chunk"))
           .applyInArrow(resolve(window, buckets, rewrite), schema))
    if not rewrite:
        return out
    back = {c: F.col("row").getField(c) for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    return out.select(*[back[c].alias(c) for c in docs.columns], F.struct("n_words", "n_removed", "removed").alias("removal"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("removed")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their repeated windows; a text in which nothing repeats stays as it is."""
    out = removals(docs, rewrite=True).drop("removal")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
starts AS (SELECT rid, ws, unnest(range(1, len(ws) - 33)) AS i FROM docs WHERE len(ws) >= 35),
windows AS (SELECT rid, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM starts),
again AS (SELECT k FROM windows GROUP BY k HAVING count(*) > 1),
gone AS (SELECT DISTINCT rid, i + j AS pos FROM windows SEMI JOIN again USING (k), range(0, 35) AS o(j)),
placed AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM docs),
kept AS (SELECT rid, string_agg(w, ' ' ORDER BY pos) AS t, count(*) AS n FROM placed ANTI JOIN gone USING (rid, pos)
         GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (rid)"""
