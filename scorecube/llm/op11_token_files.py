"""Token-ID files: flat unsigned integers and 64-bit document offsets, memory-mapped; partition bases come from prefix sums.

Documents are range-partitioned and sorted by doc_id (equal ids by text hash, equal rows by place, so that an id held by many rows
spreads over partitions). A task streams its partition, text after text, into three flat files of its own:

* ``.ids`` the token numbers, unsigned little-endian, 2 bytes each if the vocabulary has 65,536 entries at most, else 4,
* ``.off`` 64-bit offsets into them, one more than documents, from 0,
* ``.doc`` the 64-bit doc_ids.

It returns one row: names and counts. These rows, which Spark commits once for each partition whatever attempts failed, are the
manifest; a lost attempt leaves files that no row names. Prefix sums over the manifest (a row for a partition) give each
partition the documents and ids before it; with these bases they are the index, stored beside the files. A reader
takes slices of documents, maps a file and touches only its slice.

Defined results: null and empty texts have just the end id; every row is a document, also if its doc_id is null (these come first) or
repeated (then ordered by a hash of the text); special tokens' strings count as the tokenizer has them; an empty table gives
no files and no rows; other columns are not read. doc_id is read as a 64-bit integer. Where the shared folder
isn't mounted on the executors, slices are read by position instead of mapped."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_table_path
from ..sources.archives import fs_path
from ..sources.tables import read_table
from . import memo
from .common import held, input_bytes, pieces, ready, shuffle_partitions, splits

PART_BYTES = 256 << 20
SLICE_DOCS = 1 << 14
BLOCK = 1 << 20
END_ID = 1

MANIFEST = "part int, path string, n_docs bigint, n_nulls bigint, n_tokens bigint, width int"


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def _write(folder: str, vocabulary: str, end_id: int):
    def run(batches):
        tokenizer = held(("word bpe", vocabulary), lambda: memo.WordBpe(vocabulary))
        dtype = np.dtype("<u2" if tokenizer.code == "H" else "<u4")
        end = np.array([end_id], dtype).tobytes()
        files, docs, nulls, tokens = None, 0, 0, 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows and files is None:
                fs, base = fs_path(folder)
                fs.create_dir(base, recursive=True)
                name = f"part-{part:07d}-{uuid.uuid4().hex}"
                files = [fs.open_output_stream(f"{base}/{name}.{kind}") for kind in ("ids", "off", "doc")]
                files[1].write(np.zeros(1, "<i8").tobytes())
            for lo, hi, data, offsets in pieces(batch["text"]):
                raw, bounds = data.tobytes(), offsets.tolist()
                ids = [tokenizer.encode(raw[a:b]) + end for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ends = tokens + np.cumsum([len(x) // dtype.itemsize for x in ids], dtype=np.int64)
                keys = batch["doc_id"].slice(lo, hi - lo)
                files[0].write(b"".join(ids))
                files[1].write(ends.astype("<i8").tobytes())
                files[2].write(keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                docs, nulls, tokens = docs + hi - lo, nulls + keys.null_count, int(ends[-1])
        if files:
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [docs], "n_nulls": [nulls],
                "n_tokens": [tokens], "width": pa.array([dtype.itemsize], pa.int32())})
    return run


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files and returns the index: the manifest's columns, and first_doc and first_token of each partition."""
    spark = docs.sparkSession
    ready(spark)
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("place")]
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).select(
        "doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    known = input_bytes(docs) < 1 << 50  # else a source without statistics: the session's number of partitions
    parts = splits(docs, PART_BYTES) if known else shuffle_partitions(spark)
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(_write(f"{folder}/data", vocabulary, end_id), MANIFEST).write.parquet(f"{folder}/manifest")
    # a row for a partition, PART_BYTES or more of input each
    manifest = spark.read.parquet(f"{folder}/manifest").orderBy("part").collect()
    bases = np.cumsum([[0, 0], *[[r["n_docs"], r["n_tokens"]] for r in manifest]], axis=0).tolist()
    index = [(*r, *base) for r, base in zip(manifest, bases[:-1], strict=True)]
    spark.createDataFrame(index, MANIFEST + ", first_doc bigint, first_token bigint").write.parquet(f"{folder}/index")
    return spark.read.parquet(f"{folder}/index")


class Flat:
    """A flat file of numbers: mapped where the file system is mounted, else read by position."""

    def __init__(self, path: str, dtype: str):
        import pyarrow.fs as pafs
        fs, name = fs_path(path)
        self.dtype = np.dtype(dtype)
        self.map = np.memmap(name, self.dtype, "r") if isinstance(fs, pafs.LocalFileSystem) else None
        self.file = None if self.map is not None else fs.open_input_file(name)

    def __getitem__(self, part: slice) -> np.ndarray:
        if self.map is not None:
            return self.map[part]
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), self.dtype)


def _read(keep_ids: bool):
    def run(batches):
        for batch in batches:
            for s in batch.to_pylist():
                lo, hi, width = s["lo"], s["hi"], s["width"]
                ids = Flat(s["path"] + ".ids", f"<u{width}")
                offsets = np.array(Flat(s["path"] + ".off", "<i8")[lo:hi + 1])
                keys = np.array(Flat(s["path"] + ".doc", "<i8")[lo:hi])
                while lo < hi:
                    at = lo - s["lo"]  # documents of about BLOCK ids at once
                    n = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, side="right")) - 1 - at, 1)
                    n = min(n, hi - lo)
                    ends = offsets[at:at + n + 1]
                    sums, every = [], []
                    if n > 1:
                        some = ids[int(ends[0]):int(ends[-1])].astype("<u4")
                        raw = memoryview(some.view(np.uint8))
                        bounds = ((ends - ends[0]) * 4).tolist()
                        sums = [zlib.crc32(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                    else:
                        crc = 0
                        for a in range(int(ends[0]), int(ends[1]), BLOCK):
                            crc = zlib.crc32(ids[a:min(a + BLOCK, int(ends[1]))].astype("<u4").tobytes(), crc)
                        sums = [crc]
                    null = np.arange(lo, lo + n) < s["n_nulls"]
                    out = {"doc_id": pa.array(keys[at:at + n], pa.int64(), mask=null),
                           "start": pa.array(s["first_token"] + ends[:-1], pa.int64()),
                           "n_tokens": pa.array(np.diff(ends), pa.int64()), "ids_crc32": pa.array(sums, pa.int64())}
                    if keep_ids:
                        every = ids[int(ends[0]):int(ends[-1])].astype(np.int32)
                        out["ids"] = pa.ListArray.from_arrays(pa.array(ends - ends[0], pa.int32()), pa.array(every))
                    yield pa.RecordBatch.from_pydict(out)
                    lo += n
    return run


def read_tokens(index: DataFrame, keep_ids: bool = False) -> DataFrame:
    """A row for each document in the files: doc_id, start (ids before it, over all partitions), n_tokens, ids_crc32, and with
    ``keep_ids`` the ids. Slices of SLICE_DOCS documents are dealt to tasks."""
    ready(index.sparkSession)
    first = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_docs") - 1, F.lit(SLICE_DOCS).cast("bigint")))
    slices = (index.select("part", "path", "width", "n_nulls", "n_docs", "first_token", first.alias("lo"))
              .withColumn("hi", F.least(F.col("lo") + SLICE_DOCS, "n_docs"))
              .repartition(shuffle_partitions(index.sparkSession), "part", "lo"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return slices.mapInArrow(_read(keep_ids), schema)


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return read_tokens(write_tokens(docs, new_table_path(spark, "tokens"), default_vocabulary()))
