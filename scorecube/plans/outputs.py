"""Output-side queries: the sorted fact write read back (K1), sidecars (K2, K3), documents (K4), manifest (K5/Q80)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import config as C
from ..session import new_table_path
from ..sinks import documents as D
from ..sinks.fact import write_sorted_fact
from ..sources.cells import CELL_COLUMNS, cells
from .registry import register, with_cells

S = C.DEFAULT_SPEC


@register("k1_sorted_fact_roundtrip", with_cells() + f"SELECT {', '.join(CELL_COLUMNS)} FROM cells",
          doubles=(C.PCT,))
def k1_sorted_fact_roundtrip(spark, sf_dir):
    """Write the whole fact as the sorted, zstd, bounded-row-group fact table and read it back."""
    path = new_table_path(spark, "fact")
    write_sorted_fact(cells(spark, sf_dir), path)
    return spark.read.parquet(path).select(*CELL_COLUMNS)


@register("k2_entity_list", with_cells() + f"""
SELECT DISTINCT {', '.join(C.ENTITY_COLS)} FROM cells
WHERE student_group_id = 1 AND grade = 3 AND year = {S.sidecar_year}""")
def k2_entity_list(spark, sf_dir):
    return D.entity_list(cells(spark, sf_dir), S.sidecar_year)


@register("k3_subgroup_list", with_cells() + f"""
SELECT DISTINCT student_group_id, student_group_name, student_group_category FROM cells
WHERE type_id = 4 AND grade = 3 AND year = {S.sidecar_year} AND student_group_id <> 1""")
def k3_subgroup_list(spark, sf_dir):
    return D.subgroup_list(cells(spark, sf_dir), S.sidecar_year)


DOC_KEY_SQL = """CASE WHEN type_id = 4 THEN 'state'
  ELSE (CASE WHEN type_id = 5 THEN 'county' WHEN type_id = 6 THEN 'district' ELSE 'school' END) || '_' ||
       (CASE WHEN type_id = 5 THEN county_code WHEN type_id = 6 THEN district_code ELSE school_code END) END"""


@register("k4_entity_documents", with_cells(f"""
r AS (SELECT {DOC_KEY_SQL} AS doc, * FROM cells
      WHERE type_id IN (4, 5, 6, 7, 9) AND pct_met_and_above IS NOT NULL)""", """
w AS (SELECT *, max(type_id) OVER (PARTITION BY doc) AS keep_type FROM r)""") + """
SELECT doc, CAST(max(type_id) AS INTEGER) AS type_id, count(*) AS records,
       min(test_id * 1000000 + grade * 10000 + year) AS first_key, sum(pct_met_and_above) AS pct_sum,
       CAST(sum(students_tested) AS BIGINT) AS students_sum
FROM w WHERE type_id = keep_type GROUP BY doc""", doubles=("pct_sum",))
def k4_entity_documents(spark, sf_dir):
    """Per-entity documents; the check covers document set, kept type, record count, the first record key (sort
    order) and sums of the values parsed back out of the JSON text."""
    docs = D.entity_documents(cells(spark, sf_dir))
    first = F.get_json_object("json", "$[0]")
    key = (F.get_json_object(first, "$.test_id").cast("int") * 1000000
           + F.get_json_object(first, "$.grade").cast("int") * 10000
           + F.get_json_object(first, "$.year").cast("int"))
    recs = F.from_json("json", "array<struct<pct_met_and_above: double, students_tested: int>>")
    pct_sum = F.aggregate(recs, F.lit(0.0), lambda acc, r: acc + r["pct_met_and_above"])
    n_sum = F.aggregate(recs, F.lit(0).cast("long"), lambda acc, r: acc + r["students_tested"])
    return docs.select("doc", "type_id", "records", key.alias("first_key"), pct_sum.alias("pct_sum"),
                       n_sum.alias("students_sum"))


@register("q80_export_manifest", with_cells(f"""
r AS (SELECT {DOC_KEY_SQL} AS doc, * FROM cells WHERE pct_met_and_above IS NOT NULL AND type_id IN (4, 5, 6, 7, 9))""") + """
SELECT CASE type_id WHEN 4 THEN 'State' WHEN 5 THEN 'Counties' WHEN 6 THEN 'Districts' WHEN 7 THEN 'Schools'
                    ELSE 'Schools (charter)' END AS label,
       count(DISTINCT doc) AS files, count(*) AS records
FROM r GROUP BY 1""")
def q80_export_manifest(spark, sf_dir):
    return D.manifest(cells(spark, sf_dir))
