"""LM scoring with a sharded Elias-Fano bigram trie.

The model interpolates a bigram level with an add-half unigram level, with Dirichlet weights:
P(w | h) = (c(h, w) + MU * P(w)) / (c(h) + MU),  P(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)),
which sums to 1 over the V words and one unknown word. A text begins in a start context and ends with an end token.

Nothing of the model is held whole: its counts, tries and answers are dealt over hash buckets, and grow with the corpus.
1. N and V are counted first. Texts are dealt into chunks. A chunk sends each word bucket its distinct words, once, with their counts in training
   texts; the bucket answers with the whole corpus's count of each.
2. A chunk (its texts come from the same exchange) sends each bigram bucket its distinct bigrams with their training counts,
   grouped by context. A bucket adds them up, builds a trie (``eliasfano``) whose 16-bit values are the quantised
   logarithms of the smoothed bigram share c(h, w) / (c(h) + MU), and answers every bigram of a chunk by successor search
   relative to its context. Frequent contexts are split over several buckets by their successors.
3. A chunk puts scores of its texts together.
A word or bigram that fills the corpus is one entry per chunk.

Words are known by 64-bit hashes, a context by 48 bits beside its bucket, a successor by 32 bits beside its context; the quantised
share is exact to 0.02 per cent. Tokens: A-Z lower-cased, runs of bytes other than space and 09-0D, then an end.

Defined results: null and empty texts are their end token; a null doc_id is remainder 0 (crc32 of the empty text), so
learned; every row is a text of its own, also for repeated doc_ids; without training texts N and V are 0 and every
token's base is log10(1); an empty table gives an empty result; other columns are not read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from .common import LOWER, NOT_SPACE, mix, pieces, ready, remainder, splits, word_hashes, words
from .eliasfano import Trie

MU = 100.0
CHUNK_BYTES = 16 << 20
BUCKET_BYTES = 16 << 20
#: a context is split so that a bucket gets about so many of its occurrences
SPLIT = 50_000
_STEP = 5000  # quantised values for a factor of 10
_U = np.uint64
END, START = _U(0x9D5C1F2A7E3B4861), _U(0x3A86D20F5B917CE4)
_SUCCESSOR = _U(0xFFFFFFFF)


def quantised(share: np.ndarray) -> np.ndarray:
    """1 to 65535 for shares of 1e-13 to 1; 0 is kept for none."""
    return np.clip(np.rint((np.log10(np.maximum(share, 1e-13)) + 13) * _STEP), 0, 65534).astype(np.uint16) + np.uint16(1)


_SHARES = np.concatenate([[0.0], 10.0 ** (np.arange(65535) / _STEP - 13)])


def share_of(code: np.ndarray) -> np.ndarray:
    return _SHARES[code]


def _tokens(table: pa.Table):
    """(token hashes with ends, bounds: those of row r are bounds[r]:bounds[r + 1], whether each row is held out)."""
    parts, counts = [], []
    for _, _, data, offsets in pieces(table["text"]):
        data = LOWER[data]
        start, end, first = words(data, offsets, NOT_SPACE)
        h = word_hashes(data, start, end)
        parts.append(np.insert(h, first[1:], END))
        counts.append(np.diff(first) + 1)
    bounds = np.concatenate([[0], np.cumsum(np.concatenate(counts or [np.zeros(0, np.int64)]))])
    held = np.array(table["held_out"].to_pylist(), bool)
    return np.concatenate(parts or [np.zeros(0, _U)]), bounds, held


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    """Rising with the hash, so that sorted hashes are in the order of their buckets."""
    return ((h >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)


def _vocabulary(tokens, bounds, held, buckets):
    """(distinct words rising, place of each token's word among them, bucket bounds, training counts)."""
    values, at = np.unique(tokens, return_inverse=True)
    learn = np.repeat(~held, np.diff(bounds))
    return (values, at, np.searchsorted(_bucket(values, buckets), np.arange(buckets + 1)),
            np.bincount(at[learn], minlength=len(values)).astype(np.int64))


def learned_words(buckets: int):
    """mapInArrow: a task's distinct training words by bucket, and how many tokens they were."""
    def run(batches):
        values, n = np.zeros(0, _U), 0
        for batch in batches:
            tokens, bounds, held = _tokens(batch)
            own = tokens[np.repeat(~held, np.diff(bounds))]
            n += len(own)
            values = np.union1d(values, own)
        cut = np.searchsorted(_bucket(values, buckets), np.arange(buckets + 1))
        some = np.flatnonzero(np.diff(cut)).tolist()
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(some, pa.int32()), "words": pa.array([values[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
            "tokens": pa.array([n] * min(1, len(some)) + [0] * (len(some) - 1), pa.int64())})
    return run


def count_words(key, table):
    distinct = len(np.unique(np.frombuffer(b"".join(table["words"].to_pylist()), _U)))
    return pa.table({"tokens": pa.array([sum(table["tokens"].to_pylist())], pa.int64()),
                     "distinct": pa.array([distinct], pa.int64())})


def send_words(buckets: int):
    def run(key, table):
        tokens, bounds, held = _tokens(table)
        values, _, cut, counts = _vocabulary(tokens, bounds, held, buckets)
        some = np.flatnonzero(np.diff(cut)).tolist()
        return pa.table({"bucket": pa.array(some, pa.int32()), "chunk": pa.array([key[0].as_py()] * len(some), pa.int32()),
                         "words": pa.array([values[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                         "counts": pa.array([counts[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary())})
    return run


def _added(keys: np.ndarray, counts: np.ndarray):
    values, inverse = np.unique(keys, return_inverse=True)
    return values, inverse, np.bincount(inverse, counts.astype(np.float64), len(values)).astype(np.int64)


def answer_words(key, table):
    """Each chunk's words' counts in the corpus."""
    lists = [np.frombuffer(x, _U) for x in table["words"].to_pylist()]
    _, inverse, total = _added(np.concatenate(lists), np.concatenate(
        [np.frombuffer(x, np.int64) for x in table["counts"].to_pylist()]))
    parts = np.split(total[inverse], np.cumsum([len(x) for x in lists])[:-1])
    return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(lists), pa.int32()),
                     "kind": pa.array([0] * len(lists), pa.int32()),
                     "counts": pa.array([x.tobytes() for x in parts], pa.binary())})


def _bigrams(tokens, bounds, held, at, counts, starts: int, buckets: int):
    """Distinct bigrams in the order of (bucket, context, successor): (contexts, context counts, successors, training
    counts, bucket bounds), and the place of each token's bigram among them. ``counts``: of the chunk's words."""
    context, seen = np.empty_like(tokens), np.empty(len(tokens), np.int64)
    context[1:], seen[1:] = tokens[:-1], counts[at[:-1]]
    context[bounds[:-1]], seen[bounds[:-1]] = START, starts
    fine = mix(tokens, 62)
    split = (fine >> _U(32)) % (_U(1) + seen.astype(_U) // _U(SPLIT))
    bucket = _bucket(mix(context ^ mix(split, 63), 61), buckets)
    own, successor = (mix(context, 64) >> _U(16)), fine & _SUCCESSOR
    # one key for sorting, the first bits of all three; if different bigrams share it, all three are sorted by
    bits = max(1, int(buckets - 1).bit_length())
    key = bucket.astype(_U) << _U(64 - bits) | own >> _U(24) << _U(40 - bits) | successor >> _U(max(0, bits - 8))
    order = np.argsort(key)

    def changes():
        return ((successor[order][1:] != successor[order][:-1]) | (own[order][1:] != own[order][:-1])
                | (bucket[order][1:] != bucket[order][:-1]))
    new = np.ones(len(order), bool)
    new[1:] = changes()
    if (new[1:] & (key[order][1:] == key[order][:-1])).any():
        order = np.lexsort((successor, own, bucket))
        new[1:] = changes()
    number = np.cumsum(new) - 1
    place = np.empty(len(order), np.int64)
    place[order] = number
    first = order[new]
    learn = np.repeat(~held, np.diff(bounds))
    return (own[first], seen[first], successor[first], np.bincount(place[learn], minlength=len(first)),
            np.searchsorted(bucket[first], np.arange(buckets + 1)), place, seen)


def _corpus_counts(replies: pa.Table, cut: np.ndarray) -> np.ndarray:
    """The chunk's words' counts in the corpus, in the order of _vocabulary."""
    out = np.zeros(int(cut[-1]), np.int64)
    for b, x in zip(replies["bucket"].to_pylist(), replies["counts"].to_pylist(), strict=True):
        out[cut[b]:cut[b + 1]] = np.frombuffer(x, np.int64)
    return out


def send_bigrams(buckets: int, starts: int):
    def run(key, table, replies):
        tokens, bounds, held = _tokens(table)
        _, at, cut, _ = _vocabulary(tokens, bounds, held, buckets)
        own, seen, successor, counts, cuts, _, _ = _bigrams(tokens, bounds, held, at, _corpus_counts(replies, cut), starts, buckets)
        out: dict[str, list] = {k: [] for k in ("bucket", "contexts", "seen", "sizes", "successors", "counts")}
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            part = slice(cuts[b], cuts[b + 1])
            head = np.flatnonzero(np.concatenate([[True], own[part][1:] != own[part][:-1]]))
            out["bucket"].append(b)
            out["contexts"].append(own[part][head].view(np.uint8).reshape(-1, 8)[:, :6].tobytes())
            out["seen"].append(np.rint(np.log2(seen[part][head] + 1.0) * 1000).astype(np.uint16).tobytes())
            out["sizes"].append(np.diff(np.append(head, len(own[part]))).astype(np.uint32).tobytes())
            out["successors"].append(successor[part].astype(np.uint32).tobytes())
            out["counts"].append(counts[part].astype(np.uint32).tobytes())
        kinds = {"bucket": pa.int32()}
        return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()}
                        | {"chunk": pa.array([key[0].as_py()] * len(out["bucket"]), pa.int32())})
    return run


def answer_bigrams(mu: float):
    def run(key, table):
        def flat(column, kind):
            return np.frombuffer(b"".join(table[column].to_pylist()), kind)
        sizes, successor = flat("sizes", np.uint32), flat("successors", np.uint32).astype(_U)
        raw = flat("contexts", np.uint8).reshape(-1, 6)
        wide = np.zeros((len(raw), 8), np.uint8)
        wide[:, :6] = raw
        contexts, number = np.unique(wide.reshape(-1).view(_U), return_inverse=True)
        seen = np.zeros(len(contexts))
        seen[number] = 2.0 ** (flat("seen", np.uint16) / 1000) - 1
        keys, inverse, total = _added(np.repeat(number, sizes).astype(_U) << _U(32) | successor, flat("counts", np.uint32))
        context_of, last = (keys >> _U(32)).astype(np.int64), keys & _SUCCESSOR
        there = total > 0
        trie = Trie(contexts, context_of[there], last[there],
                    quantised(total[there] / (seen[context_of[there]] + mu)))
        codes = np.empty(len(keys), np.uint16)
        step = 1 << 18
        for i in range(0, len(keys), step):
            codes[i:i + step] = trie.value(contexts[context_of[i:i + step]], last[i:i + step])
        lengths = [len(x) // 4 for x in table["successors"].to_pylist()]
        parts = np.split(codes[inverse], np.cumsum(lengths)[:-1])
        return pa.table({"chunk": table["chunk"], "bucket": pa.array([key[0].as_py()] * len(lengths), pa.int32()),
                         "kind": pa.array([1] * len(lengths), pa.int32()),
                         "counts": pa.array([x.tobytes() for x in parts], pa.binary())})
    return run


def score(buckets: int, starts: int, n: int, v: int, mu: float):
    def run(key, table, replies):
        tokens, bounds, held = _tokens(table)
        _, at, cut, _ = _vocabulary(tokens, bounds, held, buckets)
        kind = np.array(replies["kind"].to_pylist())
        counts = _corpus_counts(replies.filter(pa.array(kind == 0)), cut)
        _, _, _, _, cuts, place, seen = _bigrams(tokens, bounds, held, at, counts, starts, buckets)
        codes = np.zeros(int(cuts[-1]), np.uint16)
        of_bigrams = replies.filter(pa.array(kind == 1))
        for b, x in zip(of_bigrams["bucket"].to_pylist(), of_bigrams["counts"].to_pylist(), strict=True):
            codes[cuts[b]:cuts[b + 1]] = np.frombuffer(x, np.uint16)
        alone = (counts[at] + 0.5) / (n + 0.5 * (v + 1))
        both = share_of(codes)[place] + mu / (seen + mu) * alone

        def total(values):
            return np.add.reduceat(values, bounds[:-1]) if len(bounds) > 1 else np.zeros(0)
        return pa.table({"doc_id": table["doc_id"], "held_out": table["held_out"],
                         "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                         "n_known": pa.array(total((counts[at] > 0).astype(np.int64)), pa.int64()),
                         "train_tokens": pa.array([n] * len(held), pa.int64()),
                         "base_score": pa.array(total(np.log10(alone)), pa.float64()),
                         "score": pa.array(total(np.log10(both)), pa.float64())})
    return run


def scored(docs: DataFrame, mu: float = MU) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for rows (doc_id, text, held_out); the model
    learns from the rows that aren't held out."""
    ready(docs.sparkSession)
    chunks, buckets = splits(docs, CHUNK_BYTES), splits(docs, BUCKET_BYTES)
    starts = docs.where(~F.col("held_out")).count()
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text"), "held_out")
    n, v = (docs.select("text", "held_out").mapInArrow(learned_words(buckets), "bucket int, words binary, tokens bigint")
            .groupBy("bucket").applyInArrow(count_words, "tokens bigint, distinct bigint")
            .agg(F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("distinct"), F.lit(0))).first())
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "*")
    of_words = (
        dealt.groupBy("chunk").applyInArrow(send_words(buckets), "bucket int, chunk int, words binary, counts binary")
        .groupBy("bucket").applyInArrow(answer_words, "chunk int, bucket int, kind int, counts binary"))
    of_bigrams = (dealt.groupBy("chunk").cogroup(of_words.groupBy("chunk")).applyInArrow(
        send_bigrams(buckets, starts), "bucket int, contexts binary, seen binary, sizes binary, successors binary, "
        "counts binary, chunk int").groupBy("bucket").applyInArrow(
            answer_bigrams(mu), "chunk int, bucket int, kind int, counts binary"))
    replies = of_words.unionByName(of_bigrams)
    key = docs.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(
        score(buckets, starts, n, v, mu), f"doc_id {key}, held_out boolean, n_tokens bigint, n_known bigint, "
        "train_tokens bigint, base_score double, score double")


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return scored(docs.withColumn("held_out", remainder("doc_id") == 1))
