"""Domains, fixed vocabularies and report parameters.

Everything a report hard-codes (focus entity, subject, base year, grade pair, sidecar year) is a field of
``ReportSpec`` so the same operators serve any entity.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---------------------------------------------------------------------------------------------
# Fixed values (must equal the published data conventions for results to line up)
# ---------------------------------------------------------------------------------------------
YEARS = (2015, 2016, 2017, 2018, 2019, 2021, 2022, 2023, 2024, 2025)  # 2020 was never tested
GRADES = (3, 4, 5, 6, 7, 8, 11)                                        # grades 9-10 never tested
TEST_TYPE_KEPT = "B"
TEST_IDS_KEPT = (1, 2)  # 1 = ELA, 2 = Math

TYPE_STATE = 4
TYPE_COUNTY = 5
TYPE_DISTRICT = 6
TYPE_SCHOOL = (7, 9)

COUNTY_SENTINEL = "00"
DISTRICT_SENTINEL = "00000"
SCHOOL_SENTINEL = "0000000"

SG_ALL = "All Students"
SG_EL = "EL (English learner, excluding RFEP)"
SG_FLUENT = "IFEP, RFEP, and EO (Fluent English proficient and English only)"
SG_RFEP = "RFEP (Reclassified fluent English proficient)"
SG_EO = "EO (English only)"
SG_IFEP = "IFEP (Initial fluent English proficient)"
SG_EVEREL = "EverEL"
SG_NEVEREL = "NeverEL"
SG_LTEL = "LTEL (Long-Term English learner)"
SG_EL_12 = "ELs enrolled 12 months or more"
SG_EL_L12 = "ELs enrolled less than 12 months"

# raw header -> canonical column (three yearly layouts)
COLUMN_ALIASES = {
    "Subgroup ID": "student_group_id",
    "Student Group ID": "student_group_id",
    "Test Id": "test_id",
    "Test ID": "test_id",
    "County Code": "county_code",
    "District Code": "district_code",
    "School Code": "school_code",
    "Test Year": "year",
    "Test Type": "test_type",
    "Grade": "grade",
    "Students Tested": "students_tested",
    "Total Students Tested": "students_tested",
    "Percentage Standard Met and Above": "pct_met_and_above",
    "District Name": "district_name",
    "School Name": "school_name",
    "Type ID": "type_id",
    "Type Id": "type_id",
}

ENTITY_ALIASES = {
    "County Code": "county_code",
    "District Code": "district_code",
    "School Code": "school_code",
    "County Name": "county_name",
    "District Name": "district_name",
    "School Name": "school_name",
    "Type Id": "type_id",
    "Type ID": "type_id",
}

# pandas' default missing-value tokens (text that reads as null)
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

ENTITY_COLS = ("type_id", "county_code", "county_name", "district_code", "district_name",
               "school_code", "school_name")
DOC_COLS = ("test_id", "grade", "year", "student_group_id", "student_group_name",
            "pct_met_and_above", "students_tested")
FACT_SORT_KEYS = ("year", "grade", "student_group_id", "type_id", "district_code", "school_code")

PCT = "pct_met_and_above"
N = "students_tested"


@dataclass(frozen=True)
class ReportSpec:
    """Parameters of the single-entity report and explorer queries."""

    focus_level: int = TYPE_COUNTY          # type_id of the focus entity
    focus_name_col: str = "county_name"     # column matched by the case-insensitive regex
    focus_pattern: str = "AFRICA"
    test_id: int = 2                        # subject (Math)
    base_year: int = 2015                   # index / counterfactual base
    recent_cohort_from: int = 2016          # highlighted cohorts
    grade_from: int = 3                     # cohort start/end pair
    grade_to: int = 8
    sidecar_year: int = 2019
    min_cohort_points: int = 2
    min_regression_points: int = 3
    fit_samples: int = 50
    years: tuple = field(default=YEARS)
    grades: tuple = field(default=GRADES)


DEFAULT_SPEC = ReportSpec()

# What the headers of the lookup files contain, by role (regular expressions)
GROUP_FILE_HEADERS = {"id": "Num", "name": "Demographic Name", "category": "^(?!.*ID).*Student Group"}
TEST_FILE_HEADERS = {"id": "Num", "name": "Name"}
