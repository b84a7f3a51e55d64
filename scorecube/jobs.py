"""Batch entry points (``spark-submit -m``-style): the reference's scripts as Spark jobs.

    python -m scorecube.jobs ingest    ARCHIVES FORMATS OUT [--sidecar-year 2024] [--keep-extra] [--partition-by-year]
    python -m scorecube.jobs documents FACT OUT [--merge-school-types]
    python -m scorecube.jobs report    FACT OUT [--level 6 --name-col district_name --pattern "..." --test 2]
    python -m scorecube.jobs explore   FACT OUT [--entity-type District --label "name (county)" --test-name ...]
    python -m scorecube.jobs sql       FACT "SELECT ... FROM cells ..." OUT

``FACT`` is the fact written by ``ingest`` (or a folder of the provided star-schema tables). Outputs are
written by executors under OUT; nothing is collected to the driver. The session is taken as configured by the
cluster (``getOrCreate``); ``spark.checkpoint.dir`` must name a shared folder there.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from . import config as C


def run_ingest(spark: SparkSession, archives: str, formats: str, out: str, sidecar_year: int = 2024,
               keep_extra: bool = False, partition_by_year: bool = False) -> None:
    from .sinks.documents import entity_list, subgroup_list, write_sidecar
    from .sources.conform import ingest

    ing = ingest(spark, archives, formats, out_path=f"{out}/fact", keep_extra=keep_extra,
                 partition_by=("year",) if partition_by_year else ())
    ing.quarantine.write.mode("overwrite").parquet(f"{out}/quarantine")
    ing.status.write.mode("overwrite").parquet(f"{out}/status")
    write_sidecar(entity_list(ing.fact, sidecar_year), f"{out}/entities",
                  ["type_id", "county_name", "district_name", "school_name"])
    write_sidecar(subgroup_list(ing.fact, sidecar_year), f"{out}/subgroups",
                  ["student_group_category", "student_group_name"])


def run_documents(spark: SparkSession, fact: str, out: str, merge_school_types: bool = False) -> None:
    from .sinks.documents import export_documents, manifest
    from .sources.cells import cells

    f = cells(spark, fact)
    export_documents(f, f"{out}/documents", on_conflict="merge" if merge_school_types else "last_type")
    manifest(f).write.mode("overwrite").parquet(f"{out}/manifest")


def run_report(spark: SparkSession, fact: str, out: str, spec: C.ReportSpec = C.DEFAULT_SPEC) -> list[str]:
    from .plans import report as R
    from .sinks.documents import write_report

    previous = R._SPEC[0]
    R.set_report_spec(spec)
    try:
        return write_report(spark, fact, out)
    finally:
        R.set_report_spec(previous)
        R.Report.clear(spark)


def run_explore(spark: SparkSession, fact: str, out: str, spec) -> None:
    """The comparison app's analysis for one selection: cohort grid, grade grid, status (Q72–Q74)."""
    from .plans import explorer as X

    X.cohort_grid(spark, fact, spec).write.mode("overwrite").parquet(f"{out}/cohort_grid")
    X.grade_grid(spark, fact, spec).write.mode("overwrite").parquet(f"{out}/grade_grid")
    X.run_status(spark, fact, spec).write.mode("overwrite").parquet(f"{out}/status")


def run_sql(spark: SparkSession, fact: str, query: str, out: str) -> None:
    """Ad-hoc SQL over the fact registered as the view ``cells`` (predicates reach the Parquet scan)."""
    from .sources.cells import cells

    cells(spark, fact).createOrReplaceTempView("cells")
    spark.sql(query).write.mode("overwrite").parquet(out)


def main(argv=None) -> None:
    ap = argparse.ArgumentParser(prog="scorecube.jobs")
    sub = ap.add_subparsers(dest="cmd", required=True)
    a = sub.add_parser("ingest")
    a.add_argument("archives"), a.add_argument("formats"), a.add_argument("out")
    a.add_argument("--sidecar-year", type=int, default=2024)
    a.add_argument("--keep-extra", action="store_true", help="keep raw columns outside the canonical schema")
    a.add_argument("--partition-by-year", action="store_true", help="year directories (pruned by year predicates)")
    d = sub.add_parser("documents")
    d.add_argument("fact"), d.add_argument("out")
    d.add_argument("--merge-school-types", action="store_true",
                   help="a school code under types 7 and 9 keeps both types' records (default: type 9 only)")
    r = sub.add_parser("report")
    r.add_argument("fact"), r.add_argument("out")
    r.add_argument("--level", type=int, default=C.DEFAULT_SPEC.focus_level)
    r.add_argument("--name-col", default=C.DEFAULT_SPEC.focus_name_col)
    r.add_argument("--pattern", default=C.DEFAULT_SPEC.focus_pattern)
    r.add_argument("--test", type=int, default=C.DEFAULT_SPEC.test_id)
    x = sub.add_parser("explore")
    x.add_argument("fact"), x.add_argument("out")
    x.add_argument("--entity-type", default="District", choices=["State", "District", "School"])
    x.add_argument("--label", default=None)
    x.add_argument("--test-name", default="Mathematics")
    x.add_argument("--group", type=int, default=1)
    q = sub.add_parser("sql")
    q.add_argument("fact"), q.add_argument("query"), q.add_argument("out")
    args = ap.parse_args(argv)

    spark = SparkSession.builder.appName(f"scorecube-{args.cmd}").getOrCreate()
    if args.cmd == "ingest":
        run_ingest(spark, args.archives, args.formats, args.out, args.sidecar_year, args.keep_extra,
                   args.partition_by_year)
    elif args.cmd == "documents":
        run_documents(spark, args.fact, args.out, args.merge_school_types)
    elif args.cmd == "report":
        spec = C.ReportSpec(focus_level=args.level, focus_name_col=args.name_col, focus_pattern=args.pattern,
                            test_id=args.test)
        run_report(spark, args.fact, args.out, spec)
    elif args.cmd == "explore":
        from .plans.explorer import ExplorerSpec

        run_explore(spark, args.fact, args.out, ExplorerSpec(entity_type=args.entity_type, label=args.label,
                                                            test_name=args.test_name, student_group_id=args.group))
    else:
        run_sql(spark, args.fact, args.query, args.out)


if __name__ == "__main__":
    main()
