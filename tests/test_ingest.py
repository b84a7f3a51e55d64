"""Ingestion edge cases: archive members, sniffing, quoting, Latin-1, quarantine, first-row-wins, null keys,
and the incremental (streaming) path."""

import csv
import io
import os
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from scorecube.sources.archives import discover_archives, read_members, record_blocks, unpack
from scorecube.sources.conform import conform_year, ingest
from scorecube.sources.layouts import headers, member_frame
from scorecube.streaming.incremental import (read_incremental_fact, read_incremental_quarantine, read_incremental_status,
                                             start_incremental_ingest)


def _zip(path, members: dict):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w") as zf:
        for name, data in members.items():
            zf.writestr(name, data)


def _lines(spark, tmp_dir, members, year=2016):
    p = os.path.join(tmp_dir, "a", f"sb_ca{year}_all_csv_v1.zip")
    _zip(p, members)
    arch = discover_archives(spark, os.path.join(tmp_dir, "a")).select(F.lit("data").alias("tag"), "year", "path")
    return unpack(spark, arch, os.path.join(tmp_dir, "lines"))


def _frame(spark, lines, kind="data"):
    h = [x for x in headers(lines) if x["kind"] == kind][0]
    return member_frame(lines, "data", h["year"], kind, h["line"], h["caret"])


def test_quotes_latin1_and_sniff(spark, tmp_dir):
    long_header = ",".join(f"Column Number {i}" for i in range(40))  # > 512 bytes, comma only
    data = (long_header + "\n" + ",".join(["x"] * 39) + ',"Say ""hi"", x"\n').encode("latin-1")
    data += ("caf\xe9" + ",y" * 39 + "^tail\n").encode("latin-1")  # a caret after byte 512 does not switch
    lines = _lines(spark, tmp_dir, {"main.txt": data, "entities.txt": b"County Code\n01\n"})
    h = [x for x in headers(lines) if x["kind"] == "data"][0]
    assert h["caret"] is False
    rows = _frame(spark, lines).orderBy("line_no").collect()
    assert rows[0]["Column Number 39"] == 'Say "hi", x'
    assert rows[1]["Column Number 0"] == "café"


def test_member_selection_and_missing_data(spark, tmp_dir):
    lines = _lines(spark, tmp_dir, {"readme.pdf": b"x", "sb_entities.txt": b"a\n1\n"})
    errs = lines.filter(F.col("kind") == "error").collect()
    assert len(errs) == 1 and "no main data file" in errs[0]["error"]


def _conform(spark, tmp_dir, data: str, entities: str | None):
    members = {"d.txt": data.encode("latin-1")}
    if entities is not None:
        members["entities.txt"] = entities.encode("latin-1")
    lines = _lines(spark, tmp_dir, members)
    ents = _frame(spark, lines, "entities") if entities is not None else None
    return conform_year(_frame(spark, lines), ents)


HDR = "County Code^District Code^School Code^Test Year^Student Group ID^Test Type^Test ID^Grade^Students Tested^Percentage Standard Met and Above\n"


def test_numeric_traps_quarantined(spark, tmp_dir):
    data = HDR + "".join([
        "01^00000^0000000^2016^1^B ^2^3^12.0^50\n",          # 12.0 students -> 12
        "01^00000^0000000^2016^1^B^2^3^12.5^50\n",           # non-integral -> quarantine
        "01^00000^0000000^2016^100000^B^2^3^10^*\n",         # group id out of short range -> quarantine
        "01^00000^0000000^2016^1^\tB^2^4^ 7 ^5d\n",          # padded type kept, ' 7 ' -> 7, '5d' -> null
        "01^00000^0000000^2016^1^A^2^4^7^1\n",               # other test type dropped
        "01^00000^0000000^2016^1^B^3^4^7^1\n",               # test id 3 dropped
        "01^00000^0000000^2016^1^B^2^13^7^1\n",              # grade 13 dropped
    ])
    ok, bad = _conform(spark, tmp_dir, data, "County Code^District Code^School Code^County Name\n01^00000^0000000^Alpha\n")
    got = sorted((r["grade"], r["students_tested"], r["pct_met_and_above"], r["type_id"], r["county_name"]) for r in ok.collect())
    assert got == [(3, 12, 50.0, 5, "Alpha"), (4, 7, None, 5, "Alpha")]
    assert sorted(r["_reason"] for r in bad.collect()) == ["student_group_id not a short integer",
                                                           "students_tested not a int integer"]


def test_first_entity_row_wins_and_null_keys(spark, tmp_dir):
    data = HDR + "01^00001^0000000^2016^1^B^2^3^20^50\n^^^2016^1^B^2^3^20^60\n"
    ents = ("County Code^District Code^School Code^County Name^District Name^School Name^Type Id\n"
            "01^00001^0000000^Alpha^First^^6\n01^00001^0000000^Alpha^Second^^6\n^^^Null^Keys^^7\n")
    ok, _ = _conform(spark, tmp_dir, data, ents)
    got = {r["pct_met_and_above"]: (r["district_name"], r["type_id"]) for r in ok.collect()}
    assert got[50.0] == ("First", 6)        # lowest line number wins
    assert got[60.0] == ("Keys", 7)         # null codes match null codes


def test_incremental_ingest(spark, tmp_dir):
    from scorecube.sources.cells import cells
    from render import render_archives

    src = cells(spark, "/root/testdata/sf0.001").filter(F.col("type_id") == 4)
    root = os.path.join(tmp_dir, "raw")
    render_archives(src, root, {2015: "A", 2016: "A"}).collect()
    fact, ckpt = os.path.join(tmp_dir, "fact"), os.path.join(tmp_dir, "ckpt")
    q = start_incremental_ingest(spark, os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats"), fact, ckpt)
    q.awaitTermination(300)
    first = read_incremental_fact(spark, fact).groupBy("year").count().collect()
    assert {r["year"] for r in first} == {2015, 2016}
    # a new year arrives: only it is added, earlier years untouched
    render_archives(src, root, {2018: "B"}).collect()
    q = start_incremental_ingest(spark, os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats"), fact, ckpt)
    q.awaitTermination(300)
    after = {r["year"]: r["count"] for r in read_incremental_fact(spark, fact).groupBy("year").count().collect()}
    assert set(after) == {2015, 2016, 2018}
    expected = {r["year"]: r["count"] for r in src.groupBy("year").count().collect()}
    assert after == {y: expected[y] for y in after}


def test_full_roundtrip_small(spark, tmp_dir):
    from scorecube.sources.cells import cells
    from render import render_archives

    src = cells(spark, "/root/testdata/sf0.001").filter(F.col("type_id").isin(4, 5) & F.col("year").isin(2015, 2018, 2021))
    root = os.path.join(tmp_dir, "raw")
    render_archives(src, root, {2015: "A", 2018: "B", 2021: "C"}).collect()
    ing = ingest(spark, os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats"),
                 out_path=os.path.join(tmp_dir, "fact"))
    cols = ing.fact.columns
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, ing.fact.collect()), key=key) == sorted(map(tuple, src.select(*cols).collect()), key=key)
    status = {r["year"]: (r["rows"], r["error"]) for r in ing.status.collect()}
    assert status[2019] == (0, "archive not found") and status[2015][1] is None


def test_type_from_entities_with_inline_names(spark, tmp_dir):
    hdr = ("County Code^District Code^School Code^District Name^School Name^Test Year^Student Group ID^Test Type"
           "^Test ID^Grade^Total Students Tested^Percentage Standard Met and Above\n")
    data = hdr + "01^00001^0000009^Dist^Sch^2024^1^B^2^3^30^40\n01^00001^0000000^Dist^^2024^1^B^2^3^90^41\n"
    ents = ("County Code^District Code^School Code^County Name^Type ID\n"
            "01^00001^0000009^Alpha^9\n01^00001^0000000^Alpha^6\n")
    ok, _ = _conform(spark, tmp_dir, data, ents)
    got = sorted((r["school_code"], r["type_id"], r["county_name"], r["school_name"]) for r in ok.collect())
    assert got == [("0000000", 6, "Alpha", ""), ("0000009", 9, "Alpha", "Sch")]


def test_empty_lookups_are_typed(spark):
    from scorecube.sources.conform import load_student_groups, load_tests

    lines = spark.createDataFrame([], "tag string, year int, kind string, member string, caret boolean, line_no long, line string, error string")
    g = load_student_groups(spark, lines, [])
    t = load_tests(spark, lines, [])
    assert g.count() == 0 and g.columns == ["student_group_id", "student_group_name", "student_group_category"]
    assert t.count() == 0 and t.columns == ["test_id", "test_name"]


def test_keep_extra_columns(spark, tmp_dir):
    from scorecube.sources.cells import cells
    from render import render_archives

    src = cells(spark, "/root/testdata/sf0.001").filter((F.col("type_id") == 4) & F.col("year").isin(2015, 2021))
    root = os.path.join(tmp_dir, "raw")
    render_archives(src, root, {2015: "A", 2021: "C"}).collect()
    ing = ingest(spark, os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats"),
                 out_path=os.path.join(tmp_dir, "fact"), keep_extra=True)
    assert "test_type" in ing.fact.columns
    assert {r["test_type"] for r in ing.fact.select("test_type").distinct().collect()} == {"B"}
    assert ing.fact.count() == src.count()


def test_inline_type_without_inline_names(spark, tmp_dir):
    hdr = ("County Code^District Code^School Code^Type ID^Test Year^Student Group ID^Test Type^Test ID^Grade"
           "^Students Tested^Percentage Standard Met and Above\n")
    data = hdr + "01^00001^0000009^9^2019^1^B^2^3^30^40\n01^00001^0000008^^2019^1^B^2^3^30^41\n"
    ents = ("County Code^District Code^School Code^County Name^District Name^School Name^Type Id\n"
            "01^00001^0000009^Alpha^Dist^S9^7\n01^00001^0000008^Alpha^Dist^S8^7\n")
    ok, _ = _conform(spark, tmp_dir, data, ents)
    got = sorted((r["school_code"], r["type_id"], r["school_name"]) for r in ok.collect())
    # inline type first, then the entity member's, then inference
    assert got == [("0000008", 7, "S8"), ("0000009", 9, "S9")]


def test_no_entity_member_and_header_only_member(spark, tmp_dir):
    data = HDR + "00^00000^0000000^2019^1^B^2^3^30^40\n01^00000^0000000^2019^1^B^2^3^20^41\n"
    ok, _ = _conform(spark, tmp_dir, data, None)
    got = sorted((r["county_code"], r["type_id"], r["county_name"], r["district_name"]) for r in ok.collect())
    assert got == [("00", 4, "", ""), ("01", 5, "", "")]
    empty, bad = _conform(spark, os.path.join(tmp_dir, "e"), HDR, None)
    assert empty.count() == 0 and bad.count() == 0


def test_ingest_year_without_entity_member(spark, tmp_dir):
    a = os.path.join(tmp_dir, "arch")
    _zip(os.path.join(a, "sb_ca2016_all_csv_v1.zip"),
         {"sb_ca2016_all_csv_v1.txt": (HDR + "00^00000^0000000^2016^1^B^2^3^30^40\n").encode("latin-1")})
    ing = ingest(spark, a, os.path.join(tmp_dir, "no-formats-here"))
    rows = ing.fact.collect()
    assert len(rows) == 1 and rows[0]["type_id"] == 4 and rows[0]["student_group_name"] is None
    status = {r["year"]: (r["rows"], r["error"]) for r in ing.status.collect()}
    assert status[2016] == (1, None) and status[2015] == (0, "archive not found")


def test_ingest_nothing_found(spark, tmp_dir):
    ing = ingest(spark, os.path.join(tmp_dir, "none-a"), os.path.join(tmp_dir, "none-f"))
    assert ing.fact.count() == 0
    assert {r["error"] for r in ing.status.collect()} == {"archive not found"}


def test_incremental_new_version_replaces_year(spark, tmp_dir):
    import shutil

    from scorecube.sources.cells import cells
    from render import render_archives

    src = cells(spark, "/root/testdata/sf0.001").filter(F.col("type_id") == 4)
    root = os.path.join(tmp_dir, "raw")
    render_archives(src, root, {2015: "A", 2016: "A"}).collect()
    archives, formats = os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats")
    fact, ckpt = os.path.join(tmp_dir, "fact"), os.path.join(tmp_dir, "ckpt")
    start_incremental_ingest(spark, archives, formats, fact, ckpt).awaitTermination(300)
    before = {r["year"]: r["count"] for r in read_incremental_fact(spark, fact).groupBy("year").count().collect()}
    shutil.copy(os.path.join(archives, "sb_ca2016_all_csv_v1.zip"), os.path.join(archives, "sb_ca2016_all_csv_v2.zip"))
    start_incremental_ingest(spark, archives, formats, fact, ckpt).awaitTermination(300)
    after = {r["year"]: r["count"] for r in read_incremental_fact(spark, fact).groupBy("year").count().collect()}
    assert after == before  # 2016 replaced by its new version, not appended


def test_inline_type_kept_without_entities(spark, tmp_dir):
    hdr = ("County Code^District Code^School Code^Type ID^Test Year^Student Group ID^Test Type^Test ID^Grade"
           "^Students Tested^Percentage Standard Met and Above\n")
    data = hdr + "01^00001^0000009^9^2019^1^B^2^3^30^40\n01^00001^0000008^^2019^1^B^2^3^30^41\n"
    ok, _ = _conform(spark, tmp_dir, data, None)
    got = sorted((r["school_code"], r["type_id"]) for r in ok.collect())
    assert got == [("0000008", 7), ("0000009", 9)]  # inline 9 kept; missing inline type inferred (7)


def test_partial_inline_names(spark, tmp_dir):
    hdr = ("County Code^District Code^School Code^District Name^Test Year^Student Group ID^Test Type^Test ID^Grade"
           "^Students Tested^Percentage Standard Met and Above\n")
    data = hdr + "01^00001^0000009^Inline District^2019^1^B^2^3^30^40\n01^00001^0000008^^2019^1^B^2^3^30^41\n"
    ents = ("County Code^District Code^School Code^County Name^District Name^School Name^Type Id\n"
            "01^00001^0000009^Alpha^Entity District^S9^7\n01^00001^0000008^Alpha^Entity District^S8^7\n")
    ok, _ = _conform(spark, tmp_dir, data, ents)
    got = sorted((r["school_code"], r["district_name"], r["school_name"], r["county_name"], r["type_id"])
                 for r in ok.collect())
    assert got == [("0000008", "Entity District", "S8", "Alpha", 7), ("0000009", "Inline District", "S9", "Alpha", 7)]


def test_repeated_header_names(spark, tmp_dir):
    from scorecube.sources.layouts import parse_header

    assert parse_header(" Grade ,Grade,Note,Grade", ",") == ["Grade", "Grade.1", "Note", "Grade.2"]
    hdr = HDR.rstrip("\n") + "^Note^Note\n"
    ok, _ = _conform(spark, tmp_dir, hdr + "00^00000^0000000^2019^1^B^2^3^30^40^a^b\n", None)
    assert ok.count() == 1


def test_empty_data_member_reported(spark, tmp_dir):
    a = os.path.join(tmp_dir, "arch")
    _zip(os.path.join(a, "sb_ca2016_all_csv_v1.zip"), {"sb_ca2016_all_csv_v1.txt": b""})
    ing = ingest(spark, a, os.path.join(tmp_dir, "none"))
    status = {r["year"]: (r["rows"], r["error"]) for r in ing.status.collect()}
    assert status[2016] == (0, "EmptyDataError: empty data member")


def test_co_occurring_aliases_coalesced(spark, tmp_dir):
    from scorecube import config as C

    data = "Test Id^Test ID^Note^NOTE\n1^^a^b\n^2^c^d\n"
    lines = _lines(spark, tmp_dir, {"d.txt": data.encode("latin-1")})
    h = [x for x in headers(lines) if x["kind"] == "data"][0]
    out = member_frame(lines, "data", h["year"], "data", h["line"], h["caret"], C.COLUMN_ALIASES)
    assert out.columns == ["line_no", "test_id", "Note", "NOTE.1"]  # case-only duplicates get a suffix
    assert [r["test_id"] for r in out.orderBy("line_no").collect()] == ["1", "2"]


def test_incremental_equals_batch_ingest(spark, tmp_dir):
    from scorecube.sources.cells import cells
    from render import render_archives

    src = cells(spark, "/root/testdata/sf0.001").filter(F.col("type_id").isin(4, 5) & F.col("year").isin(2015, 2018, 2021))
    root = os.path.join(tmp_dir, "raw")
    render_archives(src, root, {2015: "A", 2018: "B", 2021: "C"}).collect()
    archives, formats = os.path.join(root, "all-student-groups"), os.path.join(root, "file_formats")
    batch = ingest(spark, archives, formats, out_path=os.path.join(tmp_dir, "batch")).fact
    fact = os.path.join(tmp_dir, "inc")
    start_incremental_ingest(spark, archives, formats, fact, os.path.join(tmp_dir, "ckpt")).awaitTermination(300)
    inc = read_incremental_fact(spark, fact).select(*batch.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, inc.collect()), key=key) == sorted(map(tuple, batch.collect()), key=key)


def test_bad_years_are_reported_and_the_others_kept(spark, tmp_dir):
    """An early caret in an entity member, or a missing column, costs its own year only."""
    head = ("County Code,District Code,School Code,Test Year,Student Group ID,Test Type,Grade,Test Id,"
            "Students Tested,Percentage Standard Met and Above")
    row = "07,00000,0000000,{},1,B,05,2,40,55.5"
    ents = "County Code,District Code,School Code,County Name,District Name,School Name\n07,00000,0000000,{},,\n"
    for year, data_head, county in ((2016, head, "Good"), (2017, head, "B^d"), (2018, head.replace(",Test Type", ",Kind"), "Good")):
        _zip(os.path.join(tmp_dir, "a", f"sb_ca{year}_all_csv_v1.zip"),
             {f"sb_ca{year}_all_csv_v1.txt": f"{data_head}\n{row.format(year)}\n", f"sb_ca{year}entities_csv.txt": ents.format(county)})
    ing = ingest(spark, os.path.join(tmp_dir, "a"), os.path.join(tmp_dir, "none"))
    status = {r["year"]: (r["rows"], r["error"]) for r in ing.status.collect()}
    assert status[2016] == (1, None)
    assert status[2017][0] == 0 and "entities member lacks" in status[2017][1]
    assert status[2018][0] == 0 and "data member lacks test_type" in status[2018][1]
    assert status[2019] == (0, "archive not found")


# ---- records, members, damage ---------------------------------------------------------------------------------------
ENTS = "County Code^District Code^School Code^County Name^District Name^School Name^Type Id\n"


def test_a_quoted_line_break_stays_in_its_field(spark, tmp_dir):
    data = HDR + "01^00000^0000000^2016^1^B^2^3^30^40\n"
    for k, (written, want) in enumerate((('"Al\npha"', "Al\npha"), ('"Al\r\npha ""x"""', 'Al\r\npha "x"'), ('5" Alpha', '5" Alpha'))):
        ok, _ = _conform(spark, os.path.join(tmp_dir, str(k)), data, ENTS + f"01^00000^0000000^{written}^^^5\n")
        assert [r["county_name"] for r in ok.collect()] == [want]


@pytest.mark.parametrize("sep,block", [(b",", 7), (b"^", 64), (b"^", 1 << 20)])
def test_blocks_are_whole_records(sep, block):
    """Cut anywhere, the records are those of the csv module; a block is no longer than what was read and the record it ends in."""
    rng = random.Random(4)
    rows = [[rng.choice(["", "a", "x y", 'say "hi"', "two\nlines", "cr\rlf\r\n", sep.decode(), "caf\xe9", '"', "\n"])
             for _ in range(4)] for _ in range(300)]
    text = io.StringIO()
    csv.writer(text, delimiter=sep.decode(), lineterminator="\n").writerows(rows)
    f = io.BytesIO(text.getvalue().encode("latin-1"))
    blocks = list(record_blocks(f.read, sep, block))
    assert all(len(b) <= block + 2000 for b in blocks)
    lines = [x.replace("\ue000", "\n").replace("\ue001", "\r") for b in blocks for x in b.split("\n") if x]
    got = [next(csv.reader(io.StringIO(x, newline=""), delimiter=sep.decode())) for x in lines]
    assert got == rows


def test_a_quote_that_is_never_closed_is_an_error():
    for text in (b'a,"b\nc,d\n', b'"' + b"x" * 5000):
        with pytest.raises(ValueError, match="EOF inside string|not closed"):
            list(record_blocks(io.BytesIO(text).read, b",", 16, most=1000))


def test_members_are_read_by_tasks_of_their_own(spark, tmp_dir):
    a = os.path.join(tmp_dir, "a")
    for year in (2016, 2017):
        _zip(os.path.join(a, f"sb_ca{year}_all_csv_v1.zip"), {"d.txt": HDR.encode(), "x_entities.txt": ENTS.encode()})
    arch = discover_archives(spark, a).select(F.lit("data").alias("tag"), "year", "path")
    blocks = read_members(spark, arch)
    got = blocks.select("year", "kind", F.spark_partition_id().alias("p")).collect()
    assert {(r["year"], r["kind"]) for r in got} == {(y, k) for y in (2016, 2017) for k in ("data", "entities")}
    assert len({r["p"] for r in got}) == 4


def test_headers_read_first_blocks_only(spark, tmp_dir):
    lines = _lines(spark, tmp_dir, {"d.txt": HDR.encode(), "x_entities.txt": ENTS.encode()})
    assert {h["kind"] for h in headers(lines)} == {"data", "entities"}
    assert "EqualTo(block,0)" in lines.filter("block = 0 AND line_no = 0")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _damage(path, member):
    """Flips a byte inside the member's deflate stream."""
    with zipfile.ZipFile(path) as zf:
        info = zf.getinfo(member)
        at = info.header_offset + 30 + len(info.filename) + info.compress_size // 2
    with open(path, "r+b") as f:
        f.seek(at)
        byte = f.read(1)
        f.seek(at)
        f.write(bytes([byte[0] ^ 0xFF]))


def _release(path, year, rows, county="Alpha"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        zf.writestr(f"sb_ca{year}_all_csv.txt", HDR + "".join(rows))
        zf.writestr(f"sb_ca{year}entities.txt", ENTS + f"01^00000^0000000^{county}^^^5\n")


@pytest.mark.parametrize("member", ["sb_ca2016_all_csv.txt", "sb_ca2016entities.txt"])
def test_a_damaged_member_costs_its_own_year(spark, tmp_dir, member):
    a = os.path.join(tmp_dir, "a")
    rows = {y: [f"01^00000^0000000^{y}^1^B^2^{g}^{30 + k}^40\n" for g in (3, 4, 5) for k in range(400)] for y in (2015, 2016)}
    for y, r in rows.items():
        _release(os.path.join(a, f"sb_ca{y}_all_csv_v1.zip"), y, r)
    _damage(os.path.join(a, "sb_ca2016_all_csv_v1.zip"), member)
    ing = ingest(spark, a, os.path.join(tmp_dir, "none"), out_path=os.path.join(tmp_dir, "fact"))
    status = {r["year"]: (r["rows"], r["error"]) for r in ing.status.collect()}
    assert status[2015] == (1200, None)
    assert status[2016][0] == 0 and status[2016][1]
    assert {r["year"] for r in ing.fact.select("year").distinct().collect()} == {2015}
    with open(os.path.join(a, "sb_ca2016_all_csv_v2.zip"), "wb") as f:  # no zip at all, and the newest version
        f.write(b"not an archive" * 100)
    status = {r["year"]: (r["rows"], r["error"]) for r in ingest(spark, a, os.path.join(tmp_dir, "none")).status.collect()}
    assert status[2015] == (1200, None) and status[2016][0] == 0 and "BadZipFile" in status[2016][1]


def _table(spark, fact):
    return sorted(tuple(str(x) for x in r) for r in read_incremental_fact(spark, fact).select(
        "year", "grade", "county_name", "students_tested", "pct_met_and_above").collect())


def test_the_ledger_keeps_the_newest_version_of_each_year(spark, tmp_dir):
    """A late older version, a damaged newer one and a row of another year leave what is there unchanged."""
    a, none, fact, ckpt = (os.path.join(tmp_dir, x) for x in ("a", "none", "fact", "ckpt"))

    def run():
        start_incremental_ingest(spark, a, none, fact, ckpt).awaitTermination(300)
        return _table(spark, fact)
    row = "01^00000^0000000^{}^1^B^2^{}^{}^40\n"
    _release(os.path.join(a, "sb_ca2015_all_csv_v2.zip"), 2015, [row.format(2015, 3, 30), row.format(2015, 4, "12.5")])
    first = run()
    assert [r[:4] for r in first] == [("2015", "3", "Alpha", "30")]
    assert [(r["src_year"], r["reason"]) for r in read_incremental_quarantine(spark, fact).collect()] == [
        (2015, "students_tested not a int integer")]
    _release(os.path.join(a, "sb_ca2015_all_csv_v1.zip"), 2015, [row.format(2015, 3, 99)])
    assert run() == first
    _release(os.path.join(a, "sb_ca2016_all_csv_v1.zip"), 2016, [row.format(2016, 3, 50), row.format(2015, 5, 51)])
    second = run()
    assert [r for r in second if r in first] == first and len(second) == 3  # the stray row is there and replaces nothing
    path = os.path.join(a, "sb_ca2015_all_csv_v3.zip")
    _release(path, 2015, [row.format(2015, 3, 31)] * 500)
    _damage(path, "sb_ca2015_all_csv.txt")
    assert run() == second
    _release(os.path.join(a, "sb_ca2015_all_csv_v4.zip"), 2015, [row.format(2015, 3, 77)])
    assert [r[:4] for r in run() if r[1] == "3"] == [("2015", "3", "Alpha", "77"), ("2016", "3", "Alpha", "50")]
    seen = sorted((r["year"], r["version"], r["state"]) for r in read_incremental_status(spark, fact).collect())
    assert seen == [(2015, 1, "superseded"), (2015, 2, "read"), (2015, 3, "failed"), (2015, 4, "read"), (2016, 1, "read")]


def test_a_batch_is_committed_once(spark, tmp_dir):
    from scorecube.streaming.ledger import Ledger

    ledger = Ledger(spark, tmp_dir)
    assert ledger.current() == {} and not ledger.has(0)
    ledger.commit(0, [{"year": 2015, "version": 2, "state": "read", "rows": 1, "folder": "x"}])
    ledger.commit(1, [{"year": 2015, "version": 3, "state": "failed", "error": "e"}, {"year": 2016, "version": 1, "state": "read"}])
    assert ledger.has(0) and {y: (e["version"], e["batch"]) for y, e in ledger.current().items()} == {2015: (2, 0), 2016: (1, 1)}
    ledger.commit(0, [{"year": 2015, "version": 9, "state": "read"}])  # a batch run again finds itself there
    assert ledger.current()[2015]["version"] == 2
