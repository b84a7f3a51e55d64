"""MinHash near-dedup with odd sketches.

1. One pass over the texts gives each document its number of distinct 5-word shingles, a 128-bit digest of the set, MinHash
   band keys (30 bands of 6 samples at 85 per cent, 36 of 5 at 80) and an odd sketch: every (sample number, sample) is folded into a 512-bit parity
   bitmap, so that equal samples of two documents cancel in their XOR and its population count measures 1 - similarity
   with small error just where similarities are high. Documents of equal sets become one node (the digest), however many.
2. Nodes that share a band key are compared by sketch. What passes forms coarse groups (connected components), a superset
   of the true ones: a link at the threshold fails a sketch or all bands with a probability of BAND_MISS + SKETCH_MISS at most.
3. The full shingle sets of a coarse group's nodes meet there, and links are confirmed on them exactly. A pair whose ends
   are already joined needs no test, and a task gives back a spanning forest, never all pairs.
4. Components of the confirmed links give the classes.

A bucket or group of any size is cut into blocks of SKETCH_BLOCK or BLOCK nodes, so no task holds more than two blocks of a
group at once and nothing is capped. Each block is first compared with itself and the group's leaders, a few members that go
to every block: a node travels once, and most of a group of near copies is joined up by that. What the leaders leave apart
is then compared with the whole group, a pair of blocks at a time; nodes that are joined already don't meet again. So a
group of m near copies of which r stay apart takes m + m * r / BLOCK rows. A bounded Bloom filter tells the passes over the
texts which are in question; what it passes in error is dropped by a join.

Words: A-Z lower-cased, runs of bytes other than space and 09-0D; fewer than five words are one shingle. Defined results: null
and wordless texts have n_shingles 0 and are their own component; rows with equal doc_id are documents of their own;
a null doc_id is the smallest only among nulls; an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

from functools import cache
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bloom
from .common import LOWER, NOT_SPACE, cut_lineage, light, mix, pieces, ranges, ready, rolling, word_hashes, words
from .components import components

SHINGLE = 5
THRESHOLD, STAGE_THRESHOLD = 85, 80  # per cent: the query's and the pipeline's
SAMPLES = 180
SKETCH_BITS = 512
#: the probabilities, at most, that a pair just at the threshold shares no band and that its sketches differ too much
BAND_MISS, SKETCH_MISS = 1e-6, 3e-6
SKETCH_BLOCK, BLOCK = 512, 256
#: about so many members of a group of several blocks are compared with all the others first
LEADERS = 16
#: the bands whose buckets are compared first
FIRST_BANDS = 6

_A = mix(np.arange(SAMPLES, dtype=np.uint64), 21).astype(np.uint32) | np.uint32(1)
_B = mix(np.arange(SAMPLES, dtype=np.uint64), 22).astype(np.uint32)


class Search(NamedTuple):
    threshold: int  # per cent
    bands: int
    rows: int  # samples of a band
    limit: int  # differing sketch bits


@cache
def search(threshold: int) -> Search:
    """How pairs of ``threshold`` per cent are found: the longest bands and the smallest limit that keep BAND_MISS and
    SKETCH_MISS."""
    alike = threshold / 100
    rows = max(r for r in range(1, SAMPLES + 1) if r == 1 or (1 - alike ** r) ** (SAMPLES // r) <= BAND_MISS)
    # a differing sample flips two bits at random: the distribution of the number of odd bits after 0, 2, 4, ... flips
    up = 1 - np.arange(SKETCH_BITS + 1) / SKETCH_BITS
    odd = np.zeros(SKETCH_BITS + 1)
    odd[0] = 1
    differ = np.zeros(SKETCH_BITS + 1)
    for d in range(SAMPLES + 1):
        differ += comb(SAMPLES, d) * (1 - alike) ** d * alike ** (SAMPLES - d) * odd
        for _ in range(2):
            odd = np.concatenate([[0], odd[:-1] * up[:-1]]) + np.concatenate([odd[1:] * (1 - up[1:]), [0]])
    more = np.cumsum(differ[::-1])[::-1] - differ
    return Search(threshold, SAMPLES // rows, rows, int(np.argmax(more <= SKETCH_MISS)))


def _shingles(data, offsets):
    """(hashes of all shingles, first shingle of each row)."""
    data = LOWER[data]
    start, end, first = words(data, offsets, NOT_SPACE)
    h = word_hashes(data, start, end)
    n = np.diff(first)
    length = np.minimum(n, SHINGLE)
    count = n - length + (n > 0)
    at = ranges(first[:-1], count)
    return rolling(h, at, np.repeat(length, count)), np.concatenate([[0], np.cumsum(count)])


def _distinct(hashes, bounds):
    """Each row's sorted distinct hashes."""
    return [np.unique(hashes[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def signatures(how: Search):
    """mapInArrow: of (doc_id, text, ...), text replaced by n, node, bands, sketch."""
    @light
    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch["text"]):
                sets = _distinct(*_shingles(data, offsets))
                n = np.array([len(s) for s in sets])
                full = np.flatnonzero(n)
                bands = np.zeros((hi - lo, how.bands), np.uint64)
                sketch = np.zeros((hi - lo, SKETCH_BITS // 8), np.uint8)
                node: list = [None] * (hi - lo)
                if len(full):
                    every = np.concatenate([sets[i] for i in full])
                    cut = np.concatenate([[0], np.cumsum(n[full])[:-1]])
                    digest = np.stack([np.add.reduceat(mix(every, s), cut) for s in (31, 32)], 1)
                    for i, d in zip(full.tolist(), digest, strict=True):
                        node[i] = d.tobytes()
                    small = every.astype(np.uint32) ^ (every >> np.uint64(32)).astype(np.uint32)
                    low = np.empty((len(full), SAMPLES), np.uint64)
                    for k in range(SAMPLES):
                        low[:, k] = np.minimum.reduceat(small * _A[k] + _B[k], cut)
                    sample = mix(low ^ (np.arange(SAMPLES, dtype=np.uint64) << np.uint64(32)), 23)
                    bands[full] = mix(sample[:, :how.bands * how.rows].reshape(len(full), how.bands, how.rows).sum(axis=2), 24)
                    bits = np.zeros((len(full), SKETCH_BITS), np.uint8)
                    place = (sample % np.uint64(SKETCH_BITS)).astype(np.int64)
                    np.add.at(bits, (np.arange(len(full))[:, None], place), 1)
                    sketch[full] = np.packbits(bits & 1, axis=1)
                out = {c: batch[c].slice(lo, hi - lo) for c in batch.schema.names if c != "text"}
                out["n"] = pa.array(n, pa.int64())
                out["node"] = pa.array(node, pa.binary())
                out["bands"] = pa.array([bands[i].view(np.int64).tolist() if node[i] else [] for i in range(hi - lo)],
                                        pa.list_(pa.int64()))
                out["sketch"] = pa.array([x.tobytes() for x in sketch], pa.binary())
                yield pa.RecordBatch.from_pydict(out)
    return run


# ---- comparing the members of a group, a block or a pair of blocks at a time ----------------------------------------
def first_blocks(members: DataFrame, key: str, payload: list[str], block: int) -> DataFrame:
    """A row for each block of each group, with the structs of its members and of the group's leaders; ``members`` has node
    and its group's size. About LEADERS members lead a group of several blocks: they go to every block and tie the blocks
    together, so that a member travels once."""
    blocks = F.ceil(F.col("size") / block).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    leads = F.pmod(F.xxhash64(F.lit("leader"), "node"), F.col("size")) < LEADERS
    return (members.select(key, F.explode(F.when(leads, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(own))).alias("i"),
                           F.struct(F.lit(0).alias("own"), "node", F.col("node").alias("label"), *payload).alias("m"))
            .groupBy(key, "i").agg(F.collect_list("m").alias("members")).select("members"))


def rest_blocks(members: DataFrame, full: DataFrame, key: str, payload: list[str], block: int) -> DataFrame:
    """A row for each pair of blocks that may still hold links between labels; ``members`` has node and label, ``full`` the
    same rows with their payload. A group's most
    frequent label is its main one: the rest are compared with each other and with the main ones, the main ones never with
    each other. A group of one label gives nothing."""
    count = members.groupBy(key, "label").agg(F.count("*").alias("n"))
    group = (count.groupBy(key).agg(F.count("*").alias("labels"), F.sum("n").alias("size"),
                                    F.max(F.struct("n", "label")).alias("main")).where("labels > 1")
             .select(key, F.col("main.label").alias("main"), F.ceil(F.col("main.n") / block).cast("int").alias("mains"),
                     F.ceil((F.col("size") - F.col("main.n")) / block).cast("int").alias("rests")))
    is_main = F.col("label") == F.col("main")
    hashed = F.xxhash64("node")
    own = F.when(is_main, F.col("rests") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("rests"))).cast("int")
    last = F.when(is_main, F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1
    return (full.join(group, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), last)))
            .select(key, F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
                    F.struct("own", "node", "label", *payload).alias("m"))
            .groupBy(key, "i", "j").agg(F.collect_list("m").alias("members")).select("members"))


def _root(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def forests(exact: bool, how: Search):
    """mapInArrow: of rows of blocks, the links found between labels (a, b), as few as connect what the task's links connect."""
    @light
    def run(batches):
        joined: dict[bytes, bytes] = {}
        for batch in batches:
            a, b = [], []
            column = batch["members"]
            flat = column.flatten()
            bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(column).to_numpy(zero_copy_only=False))])
            label = flat.field("label").to_pylist()
            n = flat.field("n").to_numpy(zero_copy_only=False)
            own = flat.field("own").to_numpy(zero_copy_only=False)
            sketch = np.frombuffer(b"".join(flat.field("sketch").to_pylist()), np.uint64).reshape(-1, SKETCH_BITS // 64)
            sets = flat.field("shingles") if exact else None
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                for x, y in _links(n[lo:hi], own[lo:hi], sketch[lo:hi], label[lo:hi], joined,
                                   sets.slice(lo, hi - lo) if exact else None, how):
                    a.append(label[lo + x])
                    b.append(label[lo + y])
            yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})
    return run


def _links(n, block, sketch, label, joined, sets, how):
    """Pairs (across the blocks, if there are two) whose labels differ and ``joined`` doesn't connect yet, the most alike first."""
    if len(n) < 2:
        return []
    x, y = (np.array([0]), np.array([1])) if len(n) == 2 else np.triu_indices(len(n), 1)
    fit = 100 * np.minimum(n[x], n[y]) >= how.threshold * np.maximum(n[x], n[y])
    if (block != block[0]).any():
        fit &= block[x] != block[y]
    number: dict[bytes, int] = {}
    for v in label:
        number.setdefault(v, len(number))
        joined.setdefault(v, v)
    if len(number) < len(label):
        of = np.array([number[v] for v in label])
        fit &= of[x] != of[y]
    x, y = x[fit], y[fit]
    differ = np.bitwise_count(sketch[x] ^ sketch[y]).sum(axis=1, dtype=np.int64)
    order = np.argsort(differ, kind="stable")
    order = order[differ[order] <= how.limit]
    found, own_set = [], {}
    for p, q in zip(x[order].tolist(), y[order].tolist(), strict=True):
        s, t = _root(joined, label[p]), _root(joined, label[q])
        if s == t:
            continue
        if sets is not None:
            for k in (p, q):
                if k not in own_set:
                    own_set[k] = np.frombuffer(sets[k].as_buffer(), np.uint64)
            both = len(np.intersect1d(own_set[p], own_set[q], assume_unique=True))
            if 100 * both < how.threshold * (n[p] + n[q] - both):
                continue
        joined[s] = t
        found.append((p, q))
    return found


def _labelled(members: DataFrame, labels: DataFrame) -> DataFrame:
    """``members`` beside their labels; a node that has none yet is its own."""
    return (members.join(labels.withColumnRenamed("component", "label"), "node", "left")
            .withColumn("label", F.coalesce("label", "node")))


def _joined_up(blocks: DataFrame, labels: DataFrame | None, exact: bool, how: Search) -> DataFrame:
    """(node, component) by the links found in ``blocks`` between labels and, if given, by ``labels``."""
    links = blocks.mapInArrow(forests(exact, how), "a binary, b binary")
    return components(links if labels is None else links.unionByName(
        labels.select(F.col("node").alias("a"), F.col("component").alias("b"))))


def coarse_groups(nodes: DataFrame, how: Search) -> DataFrame:
    """(node, component) of the nodes that are linked by sketch within the buckets of their bands. The first bands join most of
    a group; a bucket of the others matters only where labels still differ."""
    members = (nodes.select("node", F.posexplode("bands").alias("band", "value"))
               .select(F.xxhash64("band", "value").alias("bucket"), "node", (F.col("band") < FIRST_BANDS).alias("first")))
    sizes = cut_lineage(members.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = members.join(sizes, "bucket")
    sketched = nodes.select("node", "n", "sketch")
    labels = _joined_up(first_blocks(shared.where("first").join(sketched, "node"), "bucket", ["n", "sketch"], SKETCH_BLOCK),
                        None, False, how)
    # a bucket of one block has been compared as a whole
    open_ = cut_lineage(_labelled(shared.where(f"not first or size > {SKETCH_BLOCK}").select("bucket", "node"), labels))
    return _joined_up(rest_blocks(open_, open_.join(sketched, "node"), "bucket", ["n", "sketch"], SKETCH_BLOCK), labels, False, how)


def confirmed_groups(docs: DataFrame, members: DataFrame, how: Search) -> DataFrame:
    """(node, component) by links confirmed on full shingle sets; ``members`` has node, n, sketch, k, group and its size."""
    payload = ["n", "sketch", "shingles"]
    labels = _joined_up(first_blocks(_sets_of(docs, members), "group", payload, BLOCK), None, True, how)
    # a group of one block has been compared as a whole
    several = _labelled(members.where(f"size > {BLOCK}"), labels)
    split = several.groupBy("group").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    open_ = cut_lineage(several.join(split.select("group"), "group"))
    if open_.isEmpty():
        return labels
    return _joined_up(rest_blocks(open_, _sets_of(docs, open_), "group", payload, BLOCK), labels, True, how)


# ---- the texts in question ----------------------------------------------------------------------------------------------
def _shingle_sets(bits: np.ndarray):
    @light
    def run(batches):
        for batch in batches:
            batch = batch.filter(pa.array(bloom.contains(bits, batch["k"].to_numpy().view(np.uint64))))
            for lo, hi, data, offsets in pieces(batch["text"]):
                sets = _distinct(*_shingles(data, offsets))
                yield pa.RecordBatch.from_pydict({"k": batch["k"].slice(lo, hi - lo), "shingles": pa.array(
                    [s.tobytes() for s in sets], pa.binary())})
    return run


ROW_KEY = ("doc_id", "text")


def row_key():
    """A long for a row's doc_id and text; rows that share it are copies of one row."""
    return F.xxhash64(*ROW_KEY)


def _sets_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` (with k: a row that has the text) beside their shingle sets."""
    bits = docs.sparkSession.sparkContext.broadcast(bloom.build(nodes.select("k")))
    sets = (docs.select(row_key().alias("k"), "text")
            .mapInArrow(lambda batches: _shingle_sets(bits.value)(batches), "k bigint, shingles binary"))
    # rows that are copies of each other have the same k: any of them will do
    return nodes.join(sets.dropDuplicates(["k"]), "k").drop("k")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """(k, doc_id, n_shingles, component_id, kept, component) for each row of ``docs``; k is row_key(). Links are at
    ``threshold`` per cent."""
    how = search(threshold)
    ready(docs.sparkSession)
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    key_type = docs.schema["doc_id"].dataType.simpleString()
    signed = cut_lineage(docs.select("doc_id", row_key().alias("k"), "text").mapInArrow(
        signatures(how), f"doc_id {key_type}, k bigint, n bigint, node binary, bands array<bigint>, sketch binary"))
    nodes = cut_lineage(signed.where("n > 0").groupBy("node").agg(
        F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.min("k").alias("k")))
    coarse = coarse_groups(nodes, how).withColumnRenamed("component", "group")
    sizes = cut_lineage(coarse.groupBy("group").agg(F.count("*").alias("size")))
    asked = cut_lineage(coarse.join(nodes.select("node", "n", "sketch", "k"), "node").join(sizes, "group"))
    linked = confirmed_groups(docs, asked, how)
    named = cut_lineage(signed.where("n > 0").select("k", "doc_id", "n", "node").join(linked, "node", "left")
                        .select("k", "doc_id", "n", F.coalesce("component", "node").alias("component")))
    least = cut_lineage(named.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    empty = signed.where("n = 0").select("k", "doc_id", "n", F.lit(None).cast("binary").alias("component"),
                                         F.col("doc_id").alias("component_id"))
    every = named.join(least, "component").select("k", "doc_id", "n", "component", "component_id").unionByName(empty)
    return every.select("k", "doc_id", F.col("n").alias("n_shingles"), "component_id",
                        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "component")


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text")).drop("k", "component")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with one of each group of near copies, linked at STAGE_THRESHOLD; of rows that are copies in doc_id and
    text too, one stays."""
    keep = near_duplicates(docs, STAGE_THRESHOLD).where("kept").select(F.col("k").alias("__k")).distinct()
    kept = docs.withColumn("__k", row_key()).join(keep, "__k", "left_semi")
    return kept.dropDuplicates(["__k"]).drop("__k")


SQL = r"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS rid, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
spread AS (SELECT rid, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM docs WHERE len(ws) > 0),
shingles AS (SELECT DISTINCT rid, md5(array_to_string(ws[i:i + 4], ' ')) AS k FROM spread),
counted AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
pairs AS (SELECT a.rid AS a, b.rid AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.k = b.k AND a.rid < b.rid
          GROUP BY a.rid, b.rid),
links AS (SELECT a, b FROM pairs JOIN counted x ON x.rid = a JOIN counted y ON y.rid = b
          WHERE 100 * common >= 85 * (x.n + y.n - common)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(rid, other) AS (SELECT rid, rid FROM docs UNION
                      SELECT r.rid, e.b FROM reach r JOIN both_ways e ON e.a = r.other),
least_id AS (SELECT r.rid, min(d.doc_id) AS component_id FROM reach r JOIN docs d ON d.rid = r.other GROUP BY r.rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id,
       doc_id IS NOT DISTINCT FROM component_id AS kept
FROM docs LEFT JOIN counted USING (rid) JOIN least_id USING (rid)"""
