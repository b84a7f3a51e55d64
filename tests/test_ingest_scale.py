"""The ingest at size: code that the JIT compiles, and joins whose broadcast side is bounded by its rows."""

import re

import pytest
from pyspark.sql import functions as F

from scorecube import config as C
from scorecube.functions import exprs as X
from scorecube.sources import conform, layouts

LINES = "tag string, year int, kind string, member string, caret boolean, line_no long, line string, error string"
HEAD = ("County Code^District Code^School Code^Test Year^Student Group ID^Test Type^Test ID^Grade^Students Tested"
        "^Percentage Standard Met and Above")
INLINE = ("County Code^District Code^School Code^District Name^School Name^Type ID^Test Year^Student Group ID^Test Type^Test ID^Grade"
          "^Total Students Tested^Percentage Standard Met and Above")
COMMAS = HEAD.replace("^", ",").replace("Student Group ID", "Subgroup ID").replace("Test ID", "Test Id")
ENTITIES = "County Code^District Code^School Code^County Name^District Name^School Name^Type ID"


def _lines(spark):
    """Three layouts; good rows, rows to drop, a quoted name, a bad number, a padded number and a percentage with a sign."""
    rows = []
    for year, caret, head, data in (
            (2015, False, COMMAS, ["01,00001,0000001,2015,1,B,1,3,20,50.5", "01,00001,0000001,2015,1,A,1,3,20,50.5",
                                   '01,00001,"0000001",2015,1,B,2,4,30,*']),
            (2021, True, HEAD, ["01^00001^0000001^2021^1^B^1^3^20^-0", "01^00001^0000002^2021^1.5^B^1^3^20^7", "01^00001^0000001^2021^1^B^3^3^1^2",
                                "01^00000^0000000^2021^1^ B ^1.0^ 11 ^+20^1e1"]),
            (2024, True, INLINE, ['01^00001^0000001^ Inline, "D" ^ School ^9^2024^1^B^2^13^5^1',
                                  '01^00001^0000001^"In ""D"""^ School ^9^2024^1^B^2^8^5^1'])):
        for kind, lines in (("data", [head, *data]), ("entities", [
                ENTITIES.replace("^", "^" if caret else ","),
                *[x if caret else x.replace("^", ",") for x in ("01^00001^0000001^ Alpha ^Dist^Sch^7", "01^00001^0000001^Beta^Late^Late^9",
                                                                "01^00000^0000000^Alpha^^^5")]])):
            rows += [("data", year, kind, kind, caret, i, line, None) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, LINES)


def _ingest(spark):
    return conform.ingest_lines(spark, _lines(spark), years=(2015, 2021, 2024))


FACTS = [
    (2015, 7, "01", "Alpha", "00001", "Dist", "0000001", "Sch", 1, 3, 20, 50.5),
    (2015, 7, "01", "Alpha", "00001", "Dist", "0000001", "Sch", 2, 4, 30, None),
    (2021, 5, "01", "Alpha", "00000", "", "0000000", "", 1, 11, 20, 10.0),
    (2021, 7, "01", "Alpha", "00001", "Dist", "0000001", "Sch", 1, 3, 20, -0.0),
    (2024, 9, "01", "Alpha", "00001", 'In "D"', "0000001", "School", 2, 8, 5, 1.0),
]


def _facts(ing):
    rows = ing.fact.select("year", "type_id", "county_code", "county_name", "district_code", "district_name", "school_code", "school_name",
                           "test_id", "grade", "students_tested", "pct_met_and_above").collect()
    return sorted((tuple(r) for r in rows), key=lambda r: tuple(map(str, r)))


def test_rows_of_three_layouts(spark):
    ing = _ingest(spark)
    assert _facts(ing) == FACTS and str(_facts(ing)[3][-1]) == "-0.0"
    assert [tuple(r) for r in ing.quarantine.collect()] == [(2021, 2, "student_group_id not a short integer")]
    assert [tuple(r) for r in ing.status.orderBy("year").collect()] == [(2015, 2, 0, None), (2021, 2, 1, None), (2024, 1, 0, None)]


@pytest.mark.parametrize("column", [None, "tag"])
def test_generated_methods_are_compiled(spark, column, capsys):
    """HotSpot leaves methods of more than 8,000 bytes to the interpreter: parse and conform of three layouts stay below."""
    lines = _lines(spark)
    heads = [h for h in layouts.headers(lines) if h["kind"] == "data"]
    rows = layouts.parse_members(lines, heads, C.COLUMN_ALIASES)
    if column is None:
        ents = layouts.parse_members(lines, [h for h in layouts.headers(lines) if h["kind"] == "entities"], C.ENTITY_ALIASES)
        inline = F.col("src_year") == 2024
        rows = conform.conform(rows, ents, inline, inline)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # an adaptive plan shows its code only once it has run
    try:
        rows.explain(mode="codegen")
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000, sizes


def test_many_entities_are_not_broadcast(spark, monkeypatch):
    hints = []
    hint = type(_lines(spark)).hint
    monkeypatch.setattr(type(_lines(spark)), "hint", lambda df, name: hints.append(name) or hint(df, name))
    monkeypatch.setattr(conform, "BROADCAST_ROWS", 1)
    assert _facts(_ingest(spark)) == FACTS and hints == ["shuffle_hash"]


def test_entities_of_several_years_are_held_once(spark):
    """An entity that is alike in several years is one row with these years; years with inline names and types ask for none."""
    _ingest(spark)
    made = []
    real = conform.written
    try:
        conform.written = lambda df, name: made.append((name, real(df, name))) or made[-1][1]
        ing = _ingest(spark)
    finally:
        conform.written = real
    assert _facts(ing) == FACTS
    held = dict(made)["entities"].select("district_code", "district_name", F.sort_array("years").alias("years")).collect()
    assert sorted(tuple(r) for r in held) == [("00000", None, [2015, 2021]), ("00001", "Dist", [2015, 2021])]


def test_files_are_bounded_by_rows(spark, tmp_path, monkeypatch):
    """A reader's tasks take files by their bytes; rows compress to so few that a task would take tens of millions."""
    from scorecube.plans import ingestion
    from scorecube.sinks import fact

    for module, rows in ((conform, "ROWS_PER_FILE"), (ingestion, "ROWS_PER_FILE"), (fact, "ROWS_PER_TASK")):
        monkeypatch.setattr(module, rows, 2)

    def most(df):
        return df.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    ingestion.write_lines(_lines(spark).coalesce(1), f"{tmp_path}/lines")
    lines = spark.read.parquet(f"{tmp_path}/lines")
    ing = conform.ingest_lines(spark, lines, years=(2015, 2021, 2024), out_path=f"{tmp_path}/fact")
    assert lines.count() == _lines(spark).count() and _facts(ing) == FACTS
    assert [most(df) for df in (lines, ing.conformed, spark.read.parquet(f"{tmp_path}/fact"))] == [2, 2, 2]


def test_numbers_read_as_by_the_pattern(spark):
    texts = ["7", "007", "-0", "0", "5.", ".5", "1.", " 7", "7 ", "7\t", "\x1f7", "7\x1f", " 7", "1e3", "1e", "+5", "-5", "1d", "0x1", "٣", "7٣",
             "1_0", "1 0", "", "9223372036854775807", "9223372036854775808", "12345678901234567890123", "NaN", "Infinity", "*", "9007199254740993", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    want = F.when(F.col("c").rlike(X.NUMERIC_TEXT), F.col("c").try_cast("double"))
    got = df.select(X.coerce_double("c").cast("string").alias("got"), want.cast("string").alias("want"), "c").collect()
    assert [(r["c"], r["got"]) for r in got] == [(r["c"], r["want"]) for r in got]


def test_ends_are_stripped_as_by_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", " a ", "\x7fa", "a\x7f", "\x00a", "é", "é ", " é", "a\n", "　", "~a~", "!", "\x1ca", None]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    want = F.regexp_replace("c", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")
    got = df.select(X.strip_ws("c").alias("got"), want.alias("want"), "c").collect()
    assert [(r["c"], r["got"]) for r in got] == [(r["c"], r["want"]) for r in got]
