"""Score cells derived from the provided star schema (the test fixture standing in for the yearly releases).

One cell = (year, level entity, test, student group, grade) with students tested and percent meeting the
standard; cells below 11 students are suppressed (null percentage). Levels nest (state ⊂ county ⊂ district ⊂ school): each is summed from
the one below it.

Plan at scale:
  orders ⋈ customer            (orders-sized shuffle on custkey)
  lineitem ⋈ (orders+customer) (lineitem-sized shuffle on orderkey)
  narrow rows dealt by supplier, year, grade and test (lineitem-sized shuffle), counted by class of segment and priority
  ⋈ geography (supplier ⋈ nation ⋈ region) onto these counts, summed by school and written once
  districts summed from schools, counties from districts, the state from counties (all combined map-side)
  each row's overlapping student groups as sums of its classes, dealt by the sort keys and sorted while narrow; names of tests and
  groups, percentage and cohort are added on the way to the file
The materialised table is written once per (session, sf_dir) under the shared checkpoint folder, range
partitioned and sorted like the published fact file so Parquet min/max statistics skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config as C
from ..session import new_table_path, path_exists, task_count
from .tables import read_table, table_path

# ---------------------------------------------------------------------------------------------
# Fixed values of the fixture (FIXTURES.md §3)
# ---------------------------------------------------------------------------------------------
SUPPRESS_BELOW = 11
MET_QUANTITY = 25
#: order years in turn take the places of the tested years, so the untested year stays a hole and no order is left out
FIRST_ORDER_YEAR = 1995
EL_SEGMENTS = ("BUILDING", "HOUSEHOLD")
# id, name, category
STUDENT_GROUPS = (
    (1, C.SG_ALL, "All"),
    (2, C.SG_EL, "English Fluency"),
    (3, C.SG_FLUENT, "English Fluency"),
    (4, C.SG_RFEP, "English Fluency"),
    (5, C.SG_EO, "English Fluency"),
    (6, C.SG_IFEP, "English Fluency"),
    (7, C.SG_EVEREL, "English Fluency"),
    (8, C.SG_NEVEREL, "English Fluency"),
    (9, C.SG_LTEL, "English Fluency"),
    (10, C.SG_EL_12, "English Learner Enrollment"),
    (11, C.SG_EL_L12, "English Learner Enrollment"),
)
TESTS = ((1, "English Language Arts/Literacy"), (2, "Mathematics"))

CELL_COLUMNS = (
    "year", "type_id", "county_code", "county_name", "district_code", "district_name", "school_code",
    "school_name", "test_id", "test_name", "student_group_id", "student_group_name", "student_group_category",
    "grade", "students_tested", "pct_met_and_above", "cohort_year",
)


def _lookup(pairs, key):
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs for x in kv]), key)


# line items are counted in these classes of segment and priority; a student group is the sum of its classes
CLASSES = ("BUILDING_12", "BUILDING", "HOUSEHOLD_12", "HOUSEHOLD", "FURNITURE", "MACHINERY", "AUTOMOBILE", "other")
GROUP_CLASSES = {1: (0, 1, 2, 3, 4, 5, 6, 7), 2: (0, 1, 2, 3), 3: (4, 5, 6, 7), 4: (4,), 5: (5,), 6: (6,),
                 7: (0, 1, 2, 3, 4), 8: (5, 6, 7), 9: (2, 3), 10: (0, 2), 11: (1, 3)}
COUNTS = [f"{c}{i}" for i in range(len(CLASSES)) for c in "nk"]


def _class(seg, prio_lt4):
    """The place in ``CLASSES`` of a segment and priority class."""
    return (F.when(seg == "BUILDING", F.when(prio_lt4, 0).otherwise(1))
            .when(seg == "HOUSEHOLD", F.when(prio_lt4, 2).otherwise(3))
            .when(seg == "FURNITURE", 4).when(seg == "MACHINERY", 5).when(seg == "AUTOMOBILE", 6).otherwise(7))


def _tested_year(order_year):
    """The tested year at the order year's place (``C.YEARS`` and on): years from the hole on are one later."""
    year = order_year + (C.YEARS[0] - FIRST_ORDER_YEAR)
    return F.when(year >= 2020, year + 1).otherwise(year)


COUNTY = ["county_code", "county_name"]
DISTRICT = COUNTY + ["district_code", "district_name"]
SCHOOL = DISTRICT + ["school_code", "school_name"]
FIXED = ["year", "grade", "test_id"]


def school_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per school, year, grade and test: line items (n) and those that met (k) of each class."""
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority")
    customer = read_table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    oc = (orders.join(customer, orders.o_custkey == customer.c_custkey)
          .select("o_orderkey",
                  _tested_year(F.year("o_orderdate")).alias("year"),
                  _class(F.col("c_mktsegment"), F.col("o_orderpriority") < F.lit("4")).alias("class")))
    lineitem = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                          "l_linestatus")
    li = lineitem.where("l_suppkey IS NOT NULL").select(
        "l_orderkey", "l_suppkey",
        F.when(F.col("l_linenumber") <= 6, F.col("l_linenumber") + 2).otherwise(F.lit(11)).alias("grade"),
        F.when(F.col("l_linestatus") == "O", F.lit(1)).otherwise(F.lit(2)).alias("test_id"),
        F.when(F.col("l_quantity") > MET_QUANTITY, 1).otherwise(0).alias("met"))
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey")
    region = read_table(spark, sf_dir, "region", "r_regionkey", "r_name")
    geo_small = nation.join(region, nation.n_regionkey == region.r_regionkey)
    supplier = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    geo = (supplier.join(geo_small, supplier.s_nationkey == geo_small.n_nationkey)
           .select("s_suppkey",
                   F.lpad((F.col("n_regionkey") + 1).cast("string"), 2, "0").alias("county_code"),
                   F.col("r_name").alias("county_name"),
                   F.lpad((F.col("n_nationkey") + 1).cast("string"), 5, "0").alias("district_code"),
                   F.col("n_name").alias("district_name"),
                   F.lpad((F.col("s_suppkey") + 1).cast("string"), 7, "0").alias("school_code"),
                   F.col("s_name").alias("school_name"),
                   # fixture rule (FIXTURES §3): every tenth school is type 9 from 2018 on – a label, no row dropped
                   (F.col("s_suppkey") % 10 == 9).alias("charter")))
    # a cell has some ten line items, so combining before the shuffle would hold nearly every row in memory for nothing: narrow
    # rows are dealt by cell, over tasks whose number follows from the rows, and counted there
    cell = ["l_suppkey", *FIXED]
    rows = (li.join(oc, li.l_orderkey == oc.o_orderkey).select(*cell, "class", "met")
            .repartition(task_count(lineitem.count()), *cell))
    k = F.col("class")
    counted = rows.groupBy(*cell).agg(*[x for i in range(len(CLASSES)) for x in (
        F.count(F.when(k == i, 1)).alias(f"n{i}"), F.coalesce(F.sum(F.when(k == i, F.col("met"))), F.lit(0)).alias(f"k{i}"))])
    # names attached to the (much smaller) counts; suppliers of one code and one name are one school
    named = (counted.join(geo, F.col("l_suppkey") == F.col("s_suppkey"))
             .withColumn("school_type",
                         F.when(F.col("charter") & (F.col("year") >= 2018), F.lit(9)).otherwise(F.lit(7))))
    return named.groupBy(*FIXED, *SCHOOL, "school_type").agg(*[F.sum(c).alias(c) for c in COUNTS])


def roll_up(schools: DataFrame) -> DataFrame:
    """The counts of all levels: districts from schools, counties from districts, the state from counties."""
    def level(df, keys, type_id):
        summed = df.groupBy(*FIXED, *keys).agg(*[F.sum(c).alias(c) for c in COUNTS])
        return summed.withColumns({"type_id": F.lit(type_id), **{c: F.lit(None).cast("string") for c in SCHOOL if c not in keys}})
    district = level(schools, DISTRICT, C.TYPE_DISTRICT)
    county = level(district, COUNTY, C.TYPE_COUNTY)
    state = level(county, [], C.TYPE_STATE)
    out = schools.withColumnRenamed("school_type", "type_id")
    for df in (district, county, state):
        out = out.unionByName(df)
    return out


def group_counts(counts: DataFrame) -> DataFrame:
    """The sums n and k of every student group of the counts' rows; groups without line items are left out."""
    def total(c, classes):
        return sum((F.col(f"{c}{i}") for i in classes[1:]), F.col(f"{c}{classes[0]}"))
    groups = F.array(*[F.struct(F.lit(g).alias("id"), total("n", cl).alias("n"), total("k", cl).alias("k"))
                       for g, cl in GROUP_CLASSES.items()])
    others = [c for c in counts.columns if c not in COUNTS]
    return (counts.select(*others, F.explode(groups).alias("g")).where("g.n > 0")
            .select(*others, F.col("g.id").alias("student_group_id"), "g.n", "g.k"))


def filled(counts: DataFrame) -> DataFrame:
    """The keys in the fact's types, with the sentinels of the upper levels."""
    blank = {"county_code": C.COUNTY_SENTINEL, "district_code": C.DISTRICT_SENTINEL, "school_code": C.SCHOOL_SENTINEL}
    return counts.select(*[F.col(c).cast("int").alias(c) for c in ("year", "type_id", "test_id", "student_group_id", "grade")],
                         *[F.coalesce(c, F.lit(blank.get(c, ""))).alias(c) for c in SCHOOL], "n", "k")


def to_cells(counts: DataFrame) -> DataFrame:
    """Cells of the group counts: names of tests and groups, the percentage (suppressed where few) and the cohort."""
    n = F.col("n")
    return counts.withColumns({
        "test_name": _lookup(TESTS, F.col("test_id")),
        "student_group_name": _lookup([(i, nm) for i, nm, _ in STUDENT_GROUPS], F.col("student_group_id")),
        "student_group_category": _lookup([(i, ct) for i, _, ct in STUDENT_GROUPS], F.col("student_group_id")),
        "students_tested": n.cast("int"),
        "pct_met_and_above": F.when(n >= SUPPRESS_BELOW, (F.col("k") * 100).cast("double") / n),
        "cohort_year": (F.col("year") - (F.col("grade") - 3)).cast("int"),
    }).select(*CELL_COLUMNS)


def derive_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells in one plan, the levels by GROUPING SETS; ``cells`` gives the same from written counts, where no level but the upper
    ones is summed again."""
    schools = group_counts(school_counts(spark, sf_dir))
    fixed = [*FIXED, "student_group_id"]
    agg = (schools.groupingSets([fixed, fixed + COUNTY, fixed + DISTRICT, fixed + SCHOOL + ["school_type"]],
                                *fixed, *SCHOOL, "school_type")
           .agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.grouping("county_code").alias("g_c"),
                F.grouping("district_code").alias("g_d"), F.grouping("school_code").alias("g_s")))
    kind = (F.when(F.col("g_c") == 1, F.lit(C.TYPE_STATE)).when(F.col("g_d") == 1, F.lit(C.TYPE_COUNTY))
            .when(F.col("g_s") == 1, F.lit(C.TYPE_DISTRICT)).otherwise(F.col("school_type")))
    return to_cells(filled(agg.withColumn("type_id", kind)))


_CACHE: dict = {}


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact table every query reads.

    ``sf_dir`` is either a folder of the provided star-schema tables – the cells are then derived and materialised
    (sorted) once per session – or the path of an ingested fact table (the output of ``ingest``), read as is."""
    from ..sinks.fact import write_sorted_fact

    if not path_exists(spark, table_path(sf_dir, "lineitem")):
        fact = spark.read.parquet(sf_dir)
        if dict(fact.dtypes).get("year") == "string":  # a year-partitioned fact read without type inference
            fact = fact.withColumn("year", F.col("year").cast("int"))
        return fact
    key = (spark.sparkContext.applicationId, table_path(sf_dir, "lineitem"))
    path = _CACHE.get(key)
    if path is None:
        path = new_table_path(spark, "cells")
        counted = new_table_path(spark, "school-counts")
        school_counts(spark, sf_dir).write.option("compression", "zstd").parquet(counted)
        schools = spark.read.parquet(counted)
        # the narrow counts are dealt and sorted; what follows from them is added on the way to the file
        write_sorted_fact(filled(group_counts(roll_up(schools))), path, finish=to_cells,
                          partitions=task_count(schools.count() * len(GROUP_CLASSES)))
        _CACHE[key] = path
    return spark.read.parquet(path)


# ---------------------------------------------------------------------------------------------
# The same derivation as DuckDB SQL (oracle side). Expects the provided tables as views.
# ---------------------------------------------------------------------------------------------
def _sql_values(rows) -> str:
    def lit(v):
        return str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


# segment -> groups determined by segment alone; EL length groups depend on the priority class
_SEG_GROUPS = (
    [(s, 1) for s in ("BUILDING", "HOUSEHOLD", "FURNITURE", "MACHINERY", "AUTOMOBILE")]
    + [("BUILDING", 2), ("HOUSEHOLD", 2), ("FURNITURE", 3), ("MACHINERY", 3), ("AUTOMOBILE", 3)]
    + [("FURNITURE", 4), ("MACHINERY", 5), ("AUTOMOBILE", 6)]
    + [("BUILDING", 7), ("HOUSEHOLD", 7), ("FURNITURE", 7), ("MACHINERY", 8), ("AUTOMOBILE", 8)]
    + [("HOUSEHOLD", 9)]
)

CELLS_SQL = f"""
sg_map(seg, gid) AS (VALUES {_sql_values(_SEG_GROUPS)}),
sg_names(gid, gname, gcat) AS (VALUES {_sql_values(STUDENT_GROUPS)}),
test_names(tid, tname) AS (VALUES {_sql_values(TESTS)}),
order_years AS (
  SELECT DISTINCT year(o_orderdate) AS order_year,
         CAST(year(o_orderdate) + {C.YEARS[0] - FIRST_ORDER_YEAR}
              + CASE WHEN year(o_orderdate) + {C.YEARS[0] - FIRST_ORDER_YEAR} >= 2020 THEN 1 ELSE 0 END AS INTEGER) AS year
  FROM orders),
cell_base AS (
  SELECT y.year,
         CASE WHEN l.l_linenumber <= 6 THEN l.l_linenumber + 2 ELSE 11 END AS grade,
         CASE WHEN l.l_linestatus = 'O' THEN 1 ELSE 2 END AS test_id,
         lpad(CAST(n.n_regionkey + 1 AS VARCHAR), 2, '0') AS county_code, r.r_name AS county_name,
         lpad(CAST(n.n_nationkey + 1 AS VARCHAR), 5, '0') AS district_code, n.n_name AS district_name,
         lpad(CAST(s.s_suppkey + 1 AS VARCHAR), 7, '0') AS school_code, s.s_name AS school_name,
         CASE WHEN s.s_suppkey % 10 = 9 AND y.year >= 2018 THEN 9 ELSE 7 END AS school_type,
         c.c_mktsegment AS seg, o.o_orderpriority < '4' AS prio_lt4,
         CASE WHEN l.l_quantity > {MET_QUANTITY} THEN 1 ELSE 0 END AS met
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN order_years y ON y.order_year = year(o.o_orderdate)
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
),
cell_members AS (
  SELECT b.*, m.gid AS student_group_id FROM cell_base b JOIN sg_map m ON b.seg = m.seg
  UNION ALL
  SELECT b.*, CASE WHEN b.prio_lt4 THEN 10 ELSE 11 END FROM cell_base b WHERE b.seg IN ('BUILDING', 'HOUSEHOLD')
),
cell_agg AS (
  SELECT year, grade, test_id, student_group_id, county_code, county_name, district_code, district_name,
         school_code, school_name, school_type, count(*) AS n, sum(met) AS k
  FROM cell_members
  GROUP BY GROUPING SETS (
    (year, grade, test_id, student_group_id),
    (year, grade, test_id, student_group_id, county_code, county_name),
    (year, grade, test_id, student_group_id, county_code, county_name, district_code, district_name),
    (year, grade, test_id, student_group_id, county_code, county_name, district_code, district_name,
     school_code, school_name, school_type))
),
cells AS (
  SELECT CAST(year AS INTEGER) AS year,
         CAST(CASE WHEN county_code IS NULL THEN 4 WHEN district_code IS NULL THEN 5
                   WHEN school_code IS NULL THEN 6 ELSE school_type END AS INTEGER) AS type_id,
         coalesce(county_code, '00') AS county_code, coalesce(county_name, '') AS county_name,
         coalesce(district_code, '00000') AS district_code, coalesce(district_name, '') AS district_name,
         coalesce(school_code, '0000000') AS school_code, coalesce(school_name, '') AS school_name,
         CAST(test_id AS INTEGER) AS test_id, t.tname AS test_name,
         CAST(student_group_id AS INTEGER) AS student_group_id, g.gname AS student_group_name,
         g.gcat AS student_group_category, CAST(grade AS INTEGER) AS grade,
         CAST(n AS INTEGER) AS students_tested,
         CASE WHEN n >= {SUPPRESS_BELOW} THEN CAST(k * 100 AS DOUBLE) / n END AS pct_met_and_above,
         CAST(year - (grade - 3) AS INTEGER) AS cohort_year
  FROM cell_agg a
  LEFT JOIN sg_names g ON a.student_group_id = g.gid
  LEFT JOIN test_names t ON a.test_id = t.tid
)"""
