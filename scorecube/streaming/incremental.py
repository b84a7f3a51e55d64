"""Incremental ingestion with Structured Streaming.

The yearly releases arrive as files; a ``binaryFile`` stream over the archive folder (path listing only – the
bytes are read by the member tasks) feeds ``foreachBatch``. A micro-batch takes the newest archive per year among the new files, leaves
out those that aren't newer than what the ledger has, ingests the others in one pass and writes their rows to a folder of the batch,
split by the year whose archive holds them. Then it commits to the ledger. So a late older version changes nothing, a damaged
archive leaves its year as it was, a row with another year's number replaces no other archive's rows, and a batch that is run again after
a failure either finds itself committed or writes its folder anew. The stream's checkpoint lives in the shared folder.
``availableNow`` processes what has arrived and stops (a scheduled job).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import config as C
from ..sinks.fact import write_sorted_fact
from ..sources.archives import ARCHIVE_GLOB, versioned
from ..sources.conform import FACT_COLUMNS, ingest_archives, lookup_archives
from .ledger import Ledger

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def _batch_writer(spark: SparkSession, formats_root: str, fact_path: str, years):
    def write(batch: DataFrame, batch_id: int) -> None:
        ledger = Ledger(spark, fact_path)
        if ledger.has(batch_id):
            return
        newest = F.max_by(F.struct("version", "path"), F.struct("version", "path")).alias("a")
        files = versioned(batch).filter(F.col("year").isin(*years)).groupBy("year").agg(newest).select("year", "a.*").collect()
        if not files:  # a row for a year
            return
        current = ledger.current()
        entries, fresh = [], []
        for f in files:
            held = current.get(f["year"])
            if held and held["version"] >= f["version"]:
                entries.append({**f.asDict(), "state": "superseded"})
            else:
                fresh.append(f)
        if fresh:
            arch = spark.createDataFrame([("data", f["year"], f["path"]) for f in fresh], "tag string, year int, path string")
            ing = ingest_archives(spark, arch, lookup_archives(spark, formats_root, years), years)
            folder = f"{fact_path.rstrip('/')}/batch={batch_id}"
            write_sorted_fact(ing.conformed.where("_reason IS NULL").select("src_year", *FACT_COLUMNS), f"{folder}/fact",
                              mode="overwrite", partition_by=("src_year",))
            ing.quarantine.write.mode("overwrite").parquet(f"{folder}/quarantine")
            status = {r["year"]: r for r in ing.status.collect()}  # a row for a year
            for f in fresh:
                s = status[f["year"]]
                entries.append({**f.asDict(), "state": "failed" if s["error"] else "read", "rows": s["rows"],
                                "quarantined": s["quarantined"], "error": s["error"], "folder": folder})
        ledger.commit(batch_id, entries)
    return write


def start_incremental_ingest(spark: SparkSession, archives_root: str, formats_root: str, fact_path: str,
                             checkpoint_path: str, years=C.YEARS, available_now: bool = True) -> StreamingQuery:
    files = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA).option("pathGlobFilter", ARCHIVE_GLOB)
             .option("recursiveFileLookup", "true").load(archives_root).select("path"))
    w = files.writeStream.foreachBatch(_batch_writer(spark, formats_root, fact_path, years))
    w = w.option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def _current(spark: SparkSession, fact_path: str, kind: str, schema: str) -> DataFrame:
    paths = {y: f"{e['folder']}/{kind}" for y, e in Ledger(spark, fact_path).current().items() if kind == "quarantine" or e["rows"]}
    if not paths:
        return spark.createDataFrame([], schema)
    if kind == "fact":
        return spark.read.parquet(*[f"{p}/src_year={y}" for y, p in sorted(paths.items())])
    held = F.coalesce(*[F.when(F.col("src_year") == y, F.col("_file").contains(p)) for y, p in paths.items()], F.lit(False))
    return spark.read.parquet(*sorted(set(paths.values()))).withColumn("_file", F.input_file_name()).filter(held).drop("_file")


def read_incremental_fact(spark: SparkSession, fact_path: str) -> DataFrame:
    """The rows of every year's current archive."""
    return _current(spark, fact_path, "fact", ", ".join(f"{c} string" for c in FACT_COLUMNS))


def read_incremental_quarantine(spark: SparkSession, fact_path: str) -> DataFrame:
    """The quarantined rows of every year's current archive: src_year, line_no, reason."""
    return _current(spark, fact_path, "quarantine", "src_year int, line_no long, reason string")


def read_incremental_status(spark: SparkSession, fact_path: str) -> DataFrame:
    """The ledger: every archive seen, by batch."""
    return Ledger(spark, fact_path).table()
