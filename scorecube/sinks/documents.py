"""Sidecar lists (K2, K3), per-entity JSON documents (K4), export manifest (K5), named result series (K6).

Documents are exported in ONE pass for all levels: a hash shuffle on the document key, a secondary sort of its records, each record
serialised as one line of the document's array, and a streaming write with ``partitionBy("doc")``. A task holds a record, never a
document. ``entity_documents`` gives the same documents as rows for callers that want one value each; there a document's
records are gathered, bounded by the key domain (tests × grades × years × groups; unique keys in the fact).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C

# (type_id, code column or None for the single state document, document prefix, manifest label)
DOC_SPECS = (
    (4, None, "state", "State"),
    (5, "county_code", "county", "Counties"),
    (6, "district_code", "district", "Districts"),
    (7, "school_code", "school", "Schools"),
    (9, "school_code", "school", "Schools (charter)"),
)


def entity_list(fact: DataFrame, year: int, grade: int = 3, group_id: int = 1) -> DataFrame:
    """K2 – distinct entities having a cell for (year, grade, group)."""
    f = fact.filter((F.col("student_group_id") == group_id) & (F.col("grade") == grade) & (F.col("year") == year))
    return f.select(*C.ENTITY_COLS).distinct()


def subgroup_list(fact: DataFrame, year: int, grade: int = 3) -> DataFrame:
    """K3 – distinct student groups at state level other than All Students."""
    f = fact.filter((F.col("type_id") == C.TYPE_STATE) & (F.col("grade") == grade) & (F.col("year") == year)
                    & (F.col("student_group_id") != 1))
    return f.select("student_group_id", "student_group_name", "student_group_category").distinct()


def write_sidecar(df: DataFrame, path: str, order) -> None:
    """Ordered JSON-lines sidecar (range-partitioned sort; part files concatenate in order)."""
    df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).write.mode("overwrite").json(path)


def _doc_key() -> F.Column:
    t = F.col("type_id")
    code = (F.when(t == 5, F.col("county_code")).when(t == 6, F.col("district_code"))
            .when(t.isin(7, 9), F.col("school_code")))
    prefix = (F.when(t == 4, F.lit("state")).when(t == 5, F.lit("county")).when(t == 6, F.lit("district"))
              .otherwise(F.lit("school")))
    return F.when(t == 4, F.lit("state")).otherwise(F.concat_ws("_", prefix, code))


def entity_documents(fact: DataFrame, on_conflict: str = "last_type") -> DataFrame:
    """K4 – one row per document: ``doc``, ``type_id`` kept, ``records``, ``json`` (compact array, nulls kept).

    Types 7 and 9 share the ``school`` prefix; by default the document keeps only the higher type's records (the
    later write wins); ``on_conflict="merge"`` keeps both."""
    rows = (fact.filter(F.col("type_id").isin(*[s[0] for s in DOC_SPECS]) & F.col(C.PCT).isNotNull())
            .withColumn("doc", _doc_key()))
    rec = F.struct(*[F.col(c) for c in C.DOC_COLS])  # struct order = sort order (test, grade, year, group)
    opts = {"ignoreNullFields": "false"}
    # ONE aggregation per document: records tagged with their type, the kept type chosen inside the group
    per_doc = rows.groupBy("doc").agg(F.max("type_id").alias("type_id"),
                                      F.collect_list(F.struct(F.col("type_id").alias("t"), rec.alias("r"))).alias("_all"))
    if on_conflict == "merge":
        kept = F.transform("_all", lambda x: x["r"])
    else:
        kept = F.transform(F.filter("_all", lambda x: x["t"] == F.col("type_id")), lambda x: x["r"])
    per_doc = (per_doc.select("doc", "type_id", F.array_sort(kept).alias("r"))
               .withColumn("records", F.size("r").cast("long")))
    return per_doc.select("doc", "type_id", "records", F.to_json("r", opts).alias("json"))


FACT_KEY = ["doc", "type_id", "year", "grade", "test_id", "student_group_id"]


def duplicate_keys(fact: DataFrame) -> DataFrame:
    """Fact keys that several rows of a document have; none means that a document is bounded by the key's domain."""
    rows = (fact.filter(F.col("type_id").isin(*[s[0] for s in DOC_SPECS]) & F.col(C.PCT).isNotNull())
            .withColumn("doc", _doc_key()))
    return rows.groupBy(*FACT_KEY).agg(F.count(F.lit(1)).alias("records")).filter("records > 1")


def export_documents(fact: DataFrame, path: str, on_conflict: str = "last_type") -> None:
    """K4 end to end: key check, then the streaming write."""
    twice = duplicate_keys(fact).limit(5).collect()
    if twice:
        raise ValueError(f"duplicate fact keys, among them {[tuple(r) for r in twice]}")
    write_documents(document_lines(fact, on_conflict), path)


def document_lines(fact: DataFrame, on_conflict: str = "last_type") -> DataFrame:
    """K4/O3 – (doc, line): the lines of each document's JSON array, one for a record, in order.

    A document's rows are sorted by type (the highest first), then by the record; the first row tells the type that is kept, a
    row's neighbour whether it is the last. These windows look at one row before or after, so they stream."""
    rows = (fact.filter(F.col("type_id").isin(*[s[0] for s in DOC_SPECS]) & F.col(C.PCT).isNotNull())
            .withColumn("doc", _doc_key()))
    record = [F.col(c).asc_nulls_first() for c in C.DOC_COLS]
    merge = on_conflict == "merge"
    w = Window.partitionBy("doc").orderBy(*([] if merge else [F.col("type_id").desc()]), *record)
    placed = rows.select("doc", "type_id", *C.DOC_COLS, F.row_number().over(w).alias("_n"), F.lead("type_id").over(w).alias("_next"),
                         F.first("type_id").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("_kept"))
    last = F.col("_next").isNull()
    if not merge:
        placed = placed.filter(F.col("type_id") == F.col("_kept"))
        last |= F.col("_next") != F.col("_kept")
    json = F.to_json(F.struct(*[F.col(c) for c in C.DOC_COLS]), {"ignoreNullFields": "false"})
    return placed.select("doc", F.concat(F.when(F.col("_n") == 1, F.lit("[")).otherwise(F.lit(",")), json,
                                         F.when(last, F.lit("]")).otherwise(F.lit(""))).alias("line"))


def write_documents(lines: DataFrame, path: str) -> None:
    """``path/doc=<name>/part-*.txt`` holding the document's JSON array, a record on each line. The lines arrive sorted by document,
    as the write wants them, so it opens one file after the other."""
    lines.select("doc", "line").write.mode("overwrite").partitionBy("doc").text(path)


def manifest(fact: DataFrame) -> DataFrame:
    """K5 – per export spec: documents (distinct codes with scored rows of that type) and records."""
    rows = fact.filter(F.col(C.PCT).isNotNull())
    label = F.lit(None).cast("string")
    for t, _, _, lab in reversed(DOC_SPECS):
        label = F.when(F.col("type_id") == t, F.lit(lab)).otherwise(label)
    code = F.when(F.col("type_id") == 4, F.lit("state")).otherwise(_doc_key())
    return (rows.withColumn("label", label).filter(F.col("label").isNotNull())
            .groupBy("label").agg(F.countDistinct(code).alias("files"), F.count(F.lit(1)).alias("records")))


def write_named_series(results: dict, out_dir: str) -> list[str]:
    """K6 – one Parquet directory per named result (``NN_slug``)."""
    paths = []
    for i, (slug, df) in enumerate(results.items(), start=1):
        p = f"{out_dir.rstrip('/')}/{i:02d}_{slug}"
        df.write.mode("overwrite").parquet(p)
        paths.append(p)
    return paths


def _is_report_series(name: str) -> bool:
    return name.startswith("q") and name[1:3].isdigit() and int(name[1:3]) <= 66


def write_report(spark, sf_dir: str, out_dir: str, select=_is_report_series) -> list[str]:
    """K6 for the whole report: every registered report series (Q01–Q66 by default), numbered in registration
    order, one Parquet directory each – each written by executors, nothing collected."""
    from ..plans import load_all

    queries, _ = load_all()
    if isinstance(select, str):
        prefix = select
        select = lambda n: n.startswith(prefix)
    results = {name: fn(spark, sf_dir) for name, fn in queries.items() if select(name)}
    return write_named_series(results, out_dir)
