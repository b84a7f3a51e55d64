"""Cross-tokenizer alignment: galloping intersection of token ends, and how many documents of the corpus link each pair of ids.

Of a piece of a few MB of texts both tokenizers give a rising list of byte offsets at which tokens end. The shorter list drives the
search: each of its values starts where an earlier one was found in the longer list, doubles its step until it has passed,
and then halves. Offsets in both lists cut the piece into groups (a document's end is always one, so no group crosses
documents); differences of the places on both sides are the ranges of tokens in a group, and all its pairs are linked.

Texts are encoded once and never shuffled. A task gathers documents into bags of about BAG_BYTES of text. A bag is one row: the
documents' figures, the distinct id pairs of the bag with how many of its documents link each, and for each document the
places of its pairs in that list and how often each is linked, as variable-length integers. A pair thus leaves a bag once,
however many documents hold it; Spark sums the counts, takes the highest of each A id, and joins them back to the bags' pairs.
No pair table is collected or broadcast by this module, and a hot pair has one row for a bag.

A group whose pairs are many is counted by its distinct ids, in blocks.

Defined results: texts that are null or empty, or whose tokens' bytes aren't a space and the text, have no tokens: zeros and an empty
groups_sha256; every row is a document, also for a repeated or null doc_id; an empty table gives an empty result; other
columns are not read."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path
from ..sources.tables import read_table
from . import memo
from .common import held, pieces, ranges, ready

BAG_BYTES = 16 << 20
#: groups with more pairs are counted by their distinct ids, so many ids of A at a time
LARGE_GROUP = 1 << 12
BLOCK = 1 << 20


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- searching ------------------------------------------------------------------------------------------------------
def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of ``short`` the first place of ``long`` that isn't below it; both rise."""
    n, m = len(short), len(long)
    if n <= 16:
        lo = np.zeros(n, np.int64)
    else:
        lo = np.repeat(gallop(short[::16], long), 16)[:n]
    hi, step = lo.copy(), 1
    going = np.arange(n)
    while True:
        going = going[hi[going] < m]
        going = going[long[hi[going]] < short[going]]
        if not len(going):
            break
        lo[going] = hi[going] + 1
        hi[going] = np.minimum(lo[going] + step, m)
        step *= 2
    going = np.flatnonzero(lo < hi)
    while len(going):
        middle = (lo[going] + hi[going]) >> 1
        below = long[middle] < short[going]
        lo[going[below]] = middle[below] + 1
        hi[going[~below]] = middle[~below]
        going = going[lo[going] < hi[going]]
    return lo


def common_places(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in both rising lists of the values that both have."""
    if len(a) > len(b):
        return common_places(b, a)[::-1]
    at = gallop(a, b)
    both = np.flatnonzero(at < len(b))
    both = both[b[at[both]] == a[both]]
    return both, at[both]


# ---- numbers as bytes -----------------------------------------------------------------------------------------------
def varint(values: np.ndarray) -> bytes:
    """Little-endian groups of 7 bits, the high bit set on all but a value's last byte."""
    values = values.astype(np.uint64)
    size = np.ones(len(values), np.int64)
    for k in range(1, 10):
        size += values >= np.uint64(1) << np.uint64(7 * k)
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    some = np.arange(len(values))
    for k in range(10):
        some = some[size[some] > k]
        if not len(some):
            break
        more = (size[some] > k + 1).astype(np.uint8) << np.uint8(7)
        out[ends[some] - size[some] + k] = (values[some] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | more
    return out.tobytes()


def from_varint(raw: bytes) -> np.ndarray:
    data = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(data < 128)
    first = np.concatenate([[0], last[:-1] + 1]) if len(last) else last
    out = np.zeros(len(last), np.int64)
    size = last - first + 1
    some = np.arange(len(last))
    for k in range(10):
        some = some[size[some] > k]
        if not len(some):
            break
        out[some] |= (data[first[some] + k].astype(np.int64) & 127) << (7 * k)
    return out


class Digits:
    """Numbers below ``size`` in decimal, as rows of bytes."""

    def __init__(self, size: int):
        number = np.arange(size)
        self.length = 1 + sum((number >= 10 ** k).astype(np.int64) for k in range(1, 8))
        self.digit = np.zeros((8, size), np.uint8)
        for k in range(8):
            some = self.length > k
            self.digit[k, some] = 48 + number[some] // 10 ** (self.length[some] - 1 - k) % 10

    def join(self, numbers: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, ends): each number followed by one byte of ``after``."""
        length = self.length[numbers]
        ends = np.cumsum(length + 1)
        out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
        start, some = ends - length - 1, None
        for k in range(int(length.max()) if len(length) else 0):
            if k == 0:
                out[start] = self.digit[0][numbers]
                continue
            some = np.flatnonzero(length > k) if some is None else some[length[some] > k]
            out[start[some] + k] = self.digit[k][numbers[some]]
        out[ends - 1] = after
        return out, ends


class Pair:
    """Both tokenizers of a worker process, and their tokens' bytes as arrays."""

    def __init__(self, a: str, b: str):
        self.a, self.b = memo.ByteBpe(a), memo.PieceBpe(b)
        self.tables = []
        for t in (self.a, self.b):
            length = np.array([len(x) for x in t.bytes], np.int64)
            self.tables.append((length, np.cumsum(length) - length, np.frombuffer(b"".join(t.bytes), np.uint8)))
        self.b_size = len(self.b.bytes)
        self.digits = Digits(max(len(self.a.bytes), self.b_size))

    def encode(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of both; none if the bytes of either aren't a space and the text."""
        text = raw.decode("utf-8", "replace")
        a, b = (np.frombuffer(x, f"<u{2 if t.code == 'H' else 4}") for t, x in
                ((self.a, self.a.encode(" " + text)), (self.b, self.b.encode(text))))
        n = len(raw) + 1
        if int(self.tables[0][0][a].sum()) != n or int(self.tables[1][0][b].sum()) != n:
            return a[:0], b[:0]
        return a, b

    def spelled(self, side: int, ids: np.ndarray) -> np.ndarray:
        length, start, data = self.tables[side]
        return data[ranges(start[ids], length[ids])]


# ---- a piece of texts -----------------------------------------------------------------------------------------------
def align(pair: Pair, texts: list[bytes]) -> dict:
    """Per text: n_a, n_b, n_groups, n_links, groups_sha256; and the links as rows (doc, key, times), key being the A id times the
    size of B plus the B id, without repeated (doc, key)."""
    ids = [pair.encode(t) if t else (None, None) for t in texts]
    live = [i for i, (a, _) in enumerate(ids) if a is not None and len(a)]
    if live:  # the spelling, for all texts at once; those that differ go
        want = np.frombuffer(b"".join(b" " + texts[i] for i in live), np.uint8)
        ends = np.cumsum([len(texts[i]) + 1 for i in live])
        wrong = np.zeros(len(want), bool)
        for side in (0, 1):
            wrong |= pair.spelled(side, np.concatenate([ids[i][side] for i in live])) != want
        if wrong.any():
            bad = set(np.unique(np.searchsorted(ends, np.flatnonzero(wrong), side="right")).tolist())
            live = [x for k, x in enumerate(live) if k not in bad]
    n = len(texts)
    out = {k: np.zeros(n, np.int64) for k in ("n_a", "n_b", "n_groups", "n_links")} | {"groups_sha256": [""] * n}
    out["links"] = (np.zeros(0, np.int64),) * 3
    if not live:
        return out
    rows = np.array(live)
    a, b = (np.concatenate([ids[i][side] for i in live]).astype(np.int64) for side in (0, 1))
    n_a, n_b = (np.array([len(ids[i][side]) for i in live], np.int64) for side in (0, 1))
    at_a, at_b = common_places(np.cumsum(pair.tables[0][0][a]), np.cumsum(pair.tables[1][0][b]))
    in_a, in_b = (np.diff(at, prepend=-1) for at in (at_a, at_b))
    from_a, from_b = at_a + 1 - in_a, at_b + 1 - in_b
    doc = np.searchsorted(np.cumsum(n_a), at_a, side="right")
    first = np.searchsorted(doc, np.arange(len(live)))
    out["n_a"][rows], out["n_b"][rows] = n_a, n_b
    out["n_groups"][rows] = np.diff(first, append=len(doc))
    out["n_links"][rows] = np.add.reduceat(in_a * in_b, first)
    # groups as text: each token followed by its separator
    numbers, after = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
    place_a = np.arange(len(a)) + np.repeat(from_b, in_a)
    place_b = np.arange(len(b)) + np.repeat(at_a + 1, in_b)
    numbers[place_a], numbers[place_b] = a, b
    after[place_a[at_a]], after[place_b[at_b]] = 124, 59
    joined, ends = pair.digits.join(numbers, after)
    stop = ends[np.cumsum(n_a + n_b) - 1].tolist()
    raw = memoryview(joined)
    for row, lo, hi in zip(live, [0, *stop[:-1]], stop, strict=True):
        out["groups_sha256"][row] = hashlib.sha256(raw[lo:hi - 1]).hexdigest()
    out["links"] = _links(a, b, from_a, in_a, from_b, in_b, rows[doc], pair.b_size)
    return out


def _links(a, b, from_a, in_a, from_b, in_b, doc, b_size: int):
    """(doc, key, times), rising by doc and key."""
    count = in_a * in_b
    large = count > LARGE_GROUP
    docs, keys, times = [], [], []
    if large.any():
        for g in np.flatnonzero(large).tolist():
            x, many_x = np.unique(a[from_a[g]:from_a[g] + in_a[g]], return_counts=True)
            y, many_y = np.unique(b[from_b[g]:from_b[g] + in_b[g]], return_counts=True)
            step = max(BLOCK // len(y), 1)
            for i in range(0, len(x), step):
                keys.append((x[i:i + step, None] * b_size + y).ravel())
                times.append((many_x[i:i + step, None] * many_y).ravel())
                docs.append(np.full(len(keys[-1]), doc[g]))
        small = ~large
        from_a, in_a, from_b, in_b, doc, count = (v[small] for v in (from_a, in_a, from_b, in_b, doc, count))
    group = np.repeat(np.arange(len(count)), count)
    k = ranges(np.zeros(len(count), np.int64), count)
    width = in_b[group]
    row = k // width
    keys.append(a[from_a[group] + row] * b_size + b[from_b[group] + k - row * width])
    docs.append(doc[group])
    if len(keys) == 1 and int(keys[0].max(initial=0)) < 1 << 40:  # one number to sort by, and all weights are 1
        both, many = np.unique(docs[0] << 40 | keys[0], return_counts=True)
        return both >> 40, both & (1 << 40) - 1, many
    docs, keys = np.concatenate(docs), np.concatenate(keys)
    times = np.concatenate([*times, np.ones(len(docs) - sum(map(len, times)), np.int64)])
    order = np.lexsort((keys, docs))
    docs, keys, times = docs[order], keys[order], times[order]
    new = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (keys[1:] != keys[:-1])])) if len(docs) else docs
    return docs[new], keys[new], np.add.reduceat(times, new) if len(new) else times


# ---- bags -----------------------------------------------------------------------------------------------------------
FIGURES = ("n_a", "n_b", "n_groups", "n_links")
BAG = ("bag bigint, doc_id array<bigint>, " + ", ".join(f"{c} array<bigint>" for c in FIGURES)
       + ", groups_sha256 array<string>, n_pairs array<bigint>, place binary, times binary, pairs binary, held_by binary")


class _Bag:
    def __init__(self):
        self.size, self.rows, self.ids, self.figures, self.shas, self.links = 0, 0, [], [], [], []

    def add(self, ids: list, got: dict, size: int) -> None:
        self.ids += ids
        self.figures.append(np.stack([got[c] for c in FIGURES]))
        self.shas += got["groups_sha256"]
        docs, keys, times = got["links"]
        self.links.append((docs + self.rows, keys.astype(np.int64), times.astype(np.int32)))
        self.rows, self.size = self.rows + len(ids), self.size + size

    def row(self, number: int) -> pa.RecordBatch:
        docs, keys, times = (np.concatenate(x) for x in zip(*self.links, strict=True))
        pairs, place, held_by = np.unique(keys, return_inverse=True, return_counts=True)
        n_pairs = np.bincount(docs, minlength=self.rows)
        step = np.diff(place, prepend=0)  # rising inside a document
        first = (np.cumsum(n_pairs) - n_pairs)[n_pairs > 0]
        step[first] = place[first]
        figures = np.concatenate(self.figures, axis=1)
        out = {"bag": pa.array([number], pa.int64()), "doc_id": pa.array([self.ids], pa.list_(pa.int64()))}
        out |= {c: pa.array([x], pa.list_(pa.int64())) for c, x in zip(FIGURES, figures, strict=True)}
        out |= {"groups_sha256": pa.array([self.shas], pa.list_(pa.string())), "n_pairs": pa.array([n_pairs], pa.list_(pa.int64()))}
        binary = {"place": varint(step), "times": varint(times), "pairs": varint(np.diff(pairs, prepend=0)),
                  "held_by": varint(held_by)}
        return pa.RecordBatch.from_pydict(out | {c: pa.array([x], pa.binary()) for c, x in binary.items()})


def _bags(a: str, b: str, bag_bytes: int):
    def run(batches):
        pair = held((a, b), lambda: Pair(a, b))
        number, bag = TaskContext.get().partitionId() << 32, _Bag()
        for batch in batches:
            for lo, hi, data, offsets in pieces(batch["text"]):
                raw, bounds = data.tobytes(), offsets.tolist()
                texts = [raw[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
                bag.add(batch["doc_id"].slice(lo, hi - lo).to_pylist(), align(pair, texts), len(raw))
                if bag.size >= bag_bytes:
                    yield bag.row(number)
                    number, bag = number + 1, _Bag()
        if bag.rows:
            yield bag.row(number)
    return run


def _unpack(batches):
    for batch in batches:
        for bag, pairs, held_by in zip(*(batch[c].to_pylist() for c in ("bag", "pairs", "held_by")), strict=True):
            keys, many = np.cumsum(from_varint(pairs)), from_varint(held_by)
            for lo in range(0, len(keys), BLOCK):
                n = len(keys[lo:lo + BLOCK])
                yield pa.RecordBatch.from_pydict({"bag": pa.array(np.full(n, bag), pa.int64()),
                                                  "pair": pa.array(keys[lo:lo + n]), "held_by": pa.array(many[lo:lo + n])})


def _pack(key, table):
    """A bag's counts, in the order of its pairs."""
    table = table.sort_by("pair")
    docs = table["docs"].to_numpy()
    best = np.packbits(table["docs"].to_numpy() == table["most"].to_numpy())
    return pa.table({"bag": pa.array([key[0].as_py()], pa.int64()), "docs": pa.array([varint(docs)], pa.binary()),
                     "best": pa.array([best.tobytes()], pa.binary())})


RESULT = ("doc_id bigint, " + ", ".join(f"{c} bigint" for c in FIGURES) + ", n_best bigint, count_sum bigint, groups_sha256 string")


def _finish(batches):
    for batch in batches:
        for i in range(batch.num_rows):
            cell = {c: batch[c][i] for c in batch.schema.names}
            n_pairs = np.array(cell["n_pairs"].values, np.int64)
            n_best, count_sum = np.zeros(len(n_pairs), np.int64), np.zeros(len(n_pairs), np.int64)
            some = np.flatnonzero(n_pairs)
            if len(some):
                first = (np.cumsum(n_pairs) - n_pairs)[some]
                step = from_varint(cell["place"].as_py())
                place = np.cumsum(step)  # steps start anew at each document
                place -= np.repeat(place[first] - step[first], n_pairs[some])
                times = from_varint(cell["times"].as_py())
                docs = from_varint(cell["docs"].as_py())
                best = np.unpackbits(np.frombuffer(cell["best"].as_py(), np.uint8), count=len(docs))
                n_best[some] = np.add.reduceat(times * best[place], first)
                count_sum[some] = np.add.reduceat(times * docs[place], first)
            out = {"doc_id": cell["doc_id"].values} | {c: cell[c].values for c in FIGURES}
            out |= {"n_best": pa.array(n_best), "count_sum": pa.array(count_sum), "groups_sha256": cell["groups_sha256"].values}
            yield pa.RecordBatch.from_pydict(out)


def alignment(docs: DataFrame, a: str, b: str, bag_bytes: int = BAG_BYTES) -> tuple[DataFrame, DataFrame]:
    """(documents, pairs). Documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. Pairs: a_id, b_id, docs
    (how many documents link them), most (the highest docs of a_id)."""
    spark = docs.sparkSession
    ready(spark)
    path = new_table_path(spark, "alignment")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    (texts.mapInArrow(_bags(a, b, bag_bytes), BAG).write.option("compression", "zstd")
     .option("parquet.block.size", 32 << 20).parquet(path))
    bags = spark.read.parquet(path)
    from sentencepiece import SentencePieceProcessor
    b_size = SentencePieceProcessor(model_file=b).get_piece_size()
    held_by = bags.select("bag", "pairs", "held_by").mapInArrow(_unpack, "bag bigint, pair bigint, held_by bigint")
    counts = held_by.groupBy("pair").agg(F.sum("held_by").alias("docs")).withColumn("a_id", F.expr(f"pair div {b_size}"))
    counts = counts.join(counts.groupBy("a_id").agg(F.max("docs").alias("most")), "a_id")
    back = held_by.select("bag", "pair").join(counts.select("pair", "docs", "most"), "pair")
    answers = back.groupBy("bag").applyInArrow(_pack, "bag bigint, docs binary, best binary")
    done = bags.drop("pairs", "held_by").join(answers, "bag", "left").mapInArrow(_finish, RESULT)
    return done, counts.select("a_id", (F.col("pair") % b_size).alias("b_id"), "docs", "most")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment(read_table(spark, sf_dir, "documents", "doc_id", "text"), *default_vocabularies())[0]
