"""Byte-level BPE encoding and decoding of whole texts in Spark tasks (the transducer and the decoder are in ``bpe``).

Defined results: null and empty texts have no tokens; special tokens' strings in a text are ordinary text; every row gives a
row, also for repeated or null doc_ids; an empty table gives an empty result; other columns are not read. The rank file's
path is a parameter and must be readable on the executors, where each worker process reads it once."""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import read_table
from . import bpe
from .common import pieces, ready


def default_vocabulary() -> tuple[str, str]:
    """(rank file, split pattern)."""
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encoded(docs: DataFrame, path: str, pattern: str, keep_ids: bool = False) -> DataFrame:
    """All columns of ``docs`` but text, and n_tokens, ids_sha256, decoded_sha256; with ``keep_ids`` also ids."""
    ready(docs.sparkSession)
    others = [c for c in docs.columns if c != "text"]

    def run(batches):
        enc = bpe.encoder(path, pattern)
        gc.freeze()  # the tables hold no cycles: collections needn't walk them
        gc.disable()
        try:
            for batch in batches:
                for lo, hi, data, offsets in pieces(batch["text"]):
                    raw, ends = data.tobytes(), offsets.tolist()
                    n, hashes, decoded, every = [], [], [], []
                    for a, b in zip(ends[:-1], ends[1:], strict=True):
                        ids = enc.encode(raw[a:b].decode("utf-8", "replace"))
                        digest = hashlib.sha256()
                        for part in enc.decode(np.frombuffer(ids, "<u4")):
                            digest.update(part.encode())
                        n.append(len(ids) // 4)
                        hashes.append(hashlib.sha256(ids).hexdigest())
                        decoded.append(digest.hexdigest())
                        if keep_ids:
                            every.append(ids)
                    out = {c: batch[c].slice(lo, hi - lo) for c in others}
                    out |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(hashes, pa.string()),
                            "decoded_sha256": pa.array(decoded, pa.string())}
                    if keep_ids:
                        out["ids"] = pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()),
                            pa.array(np.frombuffer(b"".join(every), "<i4")))
                    yield pa.RecordBatch.from_pydict(out)
        finally:
            gc.enable()
            gc.unfreeze()
    text = docs.select(*[F.col(f"`{c}`") for c in others], F.col("text").cast("string").alias("text"))
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
                       + ["n_tokens bigint", "ids_sha256 string", "decoded_sha256 string"] + ["ids array<int>"] * keep_ids)
    return text.mapInArrow(run, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(read_table(spark, sf_dir, "documents", "doc_id", "text"), *default_vocabulary())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digests of ids and of what they decode to."""
    return encoded(docs.select("doc_id", "text"), *default_vocabulary(), keep_ids=True)
