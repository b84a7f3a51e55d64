"""S1/S2 – yearly archive discovery and a data source of archive members.

``release_members`` is a Spark data source: its partitions are the members to read (one task each, so the lookup, entity and
data members of an archive are read side by side), listed from the archives' directories. A task streams its member and
returns blocks of whole records: a block ends at the last record end that lies outside quotes, so a task holds a block, never a
member. Line breaks inside quoted fields are written as private code points, which lets Spark cut a block into records with one
``split`` (``records``) and put the breaks back; cutting and parsing are then parallel over blocks, not members. What
can't be read (archive, member, a quote that is never closed) becomes a row with ``error`` for its year.
"""

from __future__ import annotations

import json
import re
import zipfile
from bisect import bisect_right
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import path_exists, ship_package

# The yearly release archive naming (year, version) and the sniffed prefix length
ARCHIVE_GLOB = "sb_ca*_all_csv_v*.zip"
ARCHIVE_RE = r"sb_ca(\d{4})_all_csv_v(\d+)\.zip$"
SNIFF_BYTES = 512

BLOCK_SCHEMA = ("tag string, year int, kind string, member string, caret boolean, block bigint, content string, "
                "error string")
LINES_SCHEMA = ("tag string, year int, kind string, member string, caret boolean, line_no long, line string, "
                "error string")
BLOCK_BYTES = 4 << 20
MOST_RECORD_BYTES = 64 << 20
#: line breaks inside quotes while a block is text (members are Latin-1, so these occur in none)
QUOTED_BREAKS = {"\n": "\ue000", "\r": "\ue001"}


def versioned(files: DataFrame) -> DataFrame:
    """(year, version, path) of the paths that are named like a yearly archive."""
    return files.select("path", F.regexp_extract("path", ARCHIVE_RE, 1).try_cast("int").alias("year"),
                        F.regexp_extract("path", ARCHIVE_RE, 2).try_cast("int").alias("version")).dropna(subset=["year"])


def discover_archives(spark: SparkSession, root: str) -> DataFrame:
    """S1 – newest version per year of ``sb_ca{year}_all_csv_v*.zip`` (deterministic, unlike a glob's order)."""
    if not path_exists(spark, root):  # every year then reports a missing archive
        return spark.createDataFrame([], "year int, path string")
    files = (spark.read.format("binaryFile").option("pathGlobFilter", ARCHIVE_GLOB)
             .option("recursiveFileLookup", "true").load(root).select("path"))
    return (versioned(files).groupBy("year")
            .agg(F.max_by("path", F.struct("version", "path")).alias("path")))


def _members(names: list[str], tag: str) -> list[tuple[str, str]]:
    """S2 – which members to read: data = first ``.txt`` without 'entities'; entities = first name with it.
    Lookup archives (tag != 'data') use their first member."""
    if tag != "data":
        return [("lookup", names[0])] if names else []
    first: dict[str, str] = {}
    for name in names:
        kind = "entities" if "entities" in name.lower() else "data" if name.endswith(".txt") else None
        if kind:
            first.setdefault(kind, name)
    return sorted(first.items())


def fs_path(uri: str):
    """(pyarrow filesystem, path) for a Hadoop-style URI (``file:/…``, ``hdfs://…``, ``s3a://…``) or a local path."""
    import pyarrow.fs as pafs

    if "://" in uri:
        return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))
    return pafs.LocalFileSystem(), (uri[len("file:"):] if uri.startswith("file:") else uri)


def _open_archive(uri: str) -> zipfile.ZipFile:
    """An archive over a seekable stream (zip needs random access to its directory)."""
    fs, path = fs_path(uri)
    return zipfile.ZipFile(fs.open_input_file(path))


def quoted_fields(sep: bytes) -> re.Pattern:
    """Quoted fields from their opening quote (at a field's start only) to the closing one, or to the end of the bytes."""
    return re.compile(rb'(?:\A|(?<=[\r\n' + re.escape(sep) + rb']))"(?:[^"]++|"")*+("?)')


def record_blocks(read, sep: bytes, block_bytes: int = BLOCK_BYTES, most: int = MOST_RECORD_BYTES):
    """Whole records, ``block_bytes`` or so at a time, as text; ``read(n)`` gives the next bytes."""
    fields, held, at_end = quoted_fields(sep), b"", False
    while not at_end:
        more = read(block_bytes)
        at_end = not more
        held += more
        spans = [(m.start(), m.end(), bool(m.group(1))) for m in fields.finditer(held)]
        if at_end:
            cut = len(held)
            if spans and not spans[-1][2]:
                raise ValueError("EOF inside string")
        else:
            cut = _last_break(held, spans)
        if not cut:
            if len(held) > most:
                raise ValueError(f"no record end in {most} bytes: a quote that is not closed?")
            continue
        text, done, parts = held[:cut].decode("latin-1"), 0, []
        for start, end, _ in spans:
            field = text[start:end]
            if end <= cut and ("\n" in field or "\r" in field):
                for own, private in QUOTED_BREAKS.items():
                    field = field.replace(own, private)
                parts += [text[done:start], field]
                done = end
        yield "".join(parts) + text[done:]
        held = held[cut:]


def _last_break(data: bytes, spans: list[tuple[int, int, bool]]) -> int:
    """The place after the last line break outside the spans; 0 if there is none. A final CR may be half a break."""
    starts, limit = [s for s, _, _ in spans], len(data)
    while limit > 0:
        at = max(data.rfind(b"\n", 0, limit), data.rfind(b"\r", 0, min(limit, len(data) - 1)))
        if at < 0:
            return 0
        k = bisect_right(starts, at) - 1
        if k < 0 or at >= spans[k][1]:
            return at + 1
        limit = starts[k]
    return 0


@dataclass
class MemberPartition(InputPartition):
    tag: str
    year: int
    path: str
    kind: str
    member: str | None
    error: str | None = None


class MemberReader(DataSourceReader):
    def __init__(self, options):
        self.archives = json.loads(options["archives"])

    def partitions(self):
        out = []
        for tag, year, path in self.archives:
            try:
                with _open_archive(path) as zf:
                    members = _members(zf.namelist(), tag)
                if tag == "data" and not any(k == "data" for k, _ in members):
                    raise FileNotFoundError("no main data file in archive")
                out += [MemberPartition(tag, year, path, kind, name) for kind, name in members]
            except Exception as e:  # noqa: BLE001 – per-archive failure isolation (S11)
                out.append(MemberPartition(tag, year, path, "error", None, f"{type(e).__name__}: {e}"))
        return out or [MemberPartition("", 0, "", "none", None)]

    def read(self, p: MemberPartition):
        def row(block, content, caret=None, kind=p.kind, error=None):
            return pa.RecordBatch.from_pylist([{"tag": p.tag, "year": p.year, "kind": kind, "member": p.member, "caret": caret,
                                                "block": block, "content": content, "error": error}], schema=_BLOCK)
        if p.kind == "none":
            return
        if p.error:
            yield row(None, None, error=p.error)
            return
        try:
            with _open_archive(p.path) as zf, zf.open(p.member) as f:
                head = f.read(SNIFF_BYTES)
                caret, pending, block = b"^" in head, [head], 0

                def read(n):
                    return pending.pop() if pending else f.read(n)
                for content in record_blocks(read, b"^" if caret else b","):
                    yield row(block, content, caret)
                    block += 1
                if p.kind == "data" and not head:
                    raise ValueError("empty data member")
        except Exception as e:  # noqa: BLE001 – a damaged member costs its own year only; its blocks are left out by `records`
            name = "EmptyDataError" if str(e) == "empty data member" else type(e).__name__
            yield row(None, None, kind="error", error=f"{name}: {e}")


_BLOCK = pa.schema([("tag", pa.string()), ("year", pa.int32()), ("kind", pa.string()), ("member", pa.string()),
                    ("caret", pa.bool_()), ("block", pa.int64()), ("content", pa.string()), ("error", pa.string())])


class ReleaseMembers(DataSource):
    """Option ``archives``: a JSON list of [tag, year, path]."""

    @classmethod
    def name(cls):
        return "release_members"

    def schema(self):
        return BLOCK_SCHEMA

    def reader(self, schema):
        return MemberReader(self.options)


def read_members(spark: SparkSession, archives: DataFrame) -> DataFrame:
    """S2 – the blocks of the members of ``archives`` (columns tag, year, path: one row for a file)."""
    ship_package(spark)
    rows = [[r["tag"], r["year"], r["path"]] for r in archives.select("tag", "year", "path").collect()]  # file names
    if not rows:
        return spark.createDataFrame([], BLOCK_SCHEMA)
    spark.dataSource.register(ReleaseMembers)
    return spark.read.format("release_members").option("archives", json.dumps(rows)).load()


def records(blocks: DataFrame) -> DataFrame:
    """The records of the blocks, and the error rows as they are. ``line_no`` rises through a member; its header has 0. ``block`` stays,
    so that a reader of headers scans first blocks only."""
    text = F.regexp_replace("content", "\r\n?", "\n")
    cut = blocks.where("block IS NOT NULL").select(
        "tag", "year", "kind", "member", "caret", "block", F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    private = "".join(QUOTED_BREAKS.values())
    lines = cut.select("tag", "year", "kind", "member", "caret", "block",
                       (F.shiftleft(F.col("block"), 32) + F.col("pos")).alias("line_no"),
                       F.translate("line", private, "".join(QUOTED_BREAKS)).alias("line"), F.lit(None).cast("string").alias("error"))
    bad = blocks.where("block IS NULL").select("tag", "year", "kind", "member", "caret", "block", F.lit(None).cast("long").alias("line_no"),
                                               F.lit(None).cast("string").alias("line"), "error")
    return lines.unionByName(bad)


def unpack(spark: SparkSession, archives: DataFrame, out_path: str) -> DataFrame:
    """S2 – the members of ``archives`` read once into a table of blocks at ``out_path``; returns their records."""
    (read_members(spark, archives).write.mode("overwrite").option("compression", "zstd")
     .option("parquet.block.size", 32 << 20).partitionBy("tag", "year", "kind").parquet(out_path))
    return records(spark.read.schema(BLOCK_SCHEMA).parquet(out_path))
