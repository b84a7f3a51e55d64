"""Column-expression helpers (all JVM-side, inside whole-stage codegen; no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config as C

# integer or decimal text with optional exponent, surrounding whitespace allowed
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INT_RANGES = {"byte": (-128, 127), "short": (-32768, 32767), "int": (-2147483648, 2147483647)}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """P4 – strip all Unicode whitespace at both ends (``trim`` removes spaces only). A text that begins and ends with a visible ASCII
    character stays as it is, which saves the pattern for nearly all."""
    c = col_(c)
    bare = (c >= "!") & (c < "\x7f") & F.substring(c, -1, 1).between("!", "~")
    return F.when(bare, c).otherwise(F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))


def na_to_null(c) -> Column:
    """S4 – text tokens that read as missing become null."""
    c = col_(c)
    return F.when(c.isin(*C.NA_TOKENS), F.lit(None).cast("string")).otherwise(c)


def coerce_double(c) -> Column:
    """P5 – coercing numeric parse: anything that is not plain numeric text becomes null. Digits alone are read as an integer, without
    the pattern: that cast is slow where it fails, may take a fraction and trims the ends, so all else is left to the pattern, and so
    are signs (minus zero)."""
    c = col_(c)
    whole = (c >= "0") & (c < ":") & F.substring(c, -1, 1).between("0", "9") & ~c.contains(".")
    return F.coalesce(F.when(whole, c.try_cast("bigint")).cast("double"),
                      F.when(c.rlike(NUMERIC_TEXT), c.try_cast("double")))  # the cast itself trims what the pattern allows at the ends


def integral_ok(d, kind: str = "int") -> Column:
    """True when a parsed double is null or an integer inside the target type's range."""
    lo, hi = INT_RANGES[kind]
    d = col_(d)
    return d.isNull() | ((d == F.floor(d)) & (d >= lo) & (d <= hi))


def checked_int(d, kind: str = "int") -> Column:
    """P6 – narrow integer cast of a parsed double; values failing ``integral_ok`` become null
    (callers route them to quarantine first)."""
    d = col_(d)
    return F.when(integral_ok(d, kind), d.cast("long")).cast(kind)


def infer_type_id(county, district, school) -> Column:
    """P7 – entity level from the code sentinels."""
    county, district, school = col_(county), col_(district), col_(school)
    return (F.when(district == C.DISTRICT_SENTINEL,
                   F.when(county == C.COUNTY_SENTINEL, F.lit(C.TYPE_STATE)).otherwise(F.lit(C.TYPE_COUNTY)))
            .when(school == C.SCHOOL_SENTINEL, F.lit(C.TYPE_DISTRICT))
            .otherwise(F.lit(7)))


def blank_if_null(c) -> Column:
    """P8 – null name -> ''."""
    return F.coalesce(strip_ws(c), F.lit(""))


def cohort_year(year="year", grade="grade") -> Column:
    """P9 – the year the cohort was in grade 3."""
    return (col_(year) - (col_(grade) - 3)).cast("int")


def _present(c) -> Column:
    return c.isNotNull() & (F.trim(c) != "")


def district_label(name="district_name", county="county_name") -> Column:
    """P10 – ``name (county)``; the name alone when the county is blank."""
    name, county = col_(name), col_(county)
    return F.when(_present(county), F.format_string("%s (%s)", name, county)).otherwise(name)


def school_label(school="school_name", district="district_name", county="county_name") -> Column:
    """P11 – ``school — district (county)``; the school alone when the district is blank."""
    school, district, county = col_(school), col_(district), col_(county)
    return F.when(_present(district), F.format_string("%s — %s (%s)", school, district, county)).otherwise(school)


def label_part_before(label, sep: str) -> Column:
    """P12 – text before the first ``sep`` (stripped)."""
    return F.trim(F.split(col_(label), sep, 2).getItem(0))


def label_part_after(label, sep: str) -> Column:
    """P12 – the piece between the first and the second ``sep`` (a plain split's second element); null when
    ``sep`` is absent."""
    parts = F.split(col_(label), sep)
    return F.when(F.size(parts) > 1, parts.getItem(1))


def subject_id(test_name) -> Column:
    """P13 – ELA (1) when the name mentions English or ELA, else Math (2)."""
    t = col_(test_name)
    return F.when(t.contains("English") | t.contains("ELA"), F.lit(1)).otherwise(F.lit(2))


def grade_label(grade="grade") -> Column:
    """P14."""
    return F.format_string("Grade %d", col_(grade))


SPLITTER = float((1 << 27) + 1)


def scaled_half_even(v, scale: int) -> Column:
    """|v| * scale as the nearest integer, ties to even, decided on the exact value of the double.

    The whole part is scaled as an integer. The product of the rest is error-free: the double is split into two halves of 26
    bits (Veltkamp), so that ``high * scale`` and ``low * scale`` are exact, and what rounding the full product lost is
    known (Dekker). ``scale`` has 20 bits at most."""
    v = F.abs(col_(v))
    whole = F.floor(v)
    rest = v - whole.cast("double")
    big = rest * F.lit(SPLITTER)
    high = big - (big - rest)
    low = rest - high
    product = rest * F.lit(float(scale))
    lost = (high * F.lit(float(scale)) - product) + low * F.lit(float(scale))
    below = F.floor(product)
    over = (product - below.cast("double")) - F.lit(0.5)  # exact: both are multiples of the product's last place
    result = whole * scale + below
    up = (over > -lost) | ((over == -lost) & (result % 2 != 0))
    return (result + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("long")


def _fixed(v, digits: int) -> Column:
    """|v| with ``digits`` decimals."""
    if not digits:
        return scaled_half_even(v, 1).cast("string")
    t = scaled_half_even(v, 10 ** digits)
    return F.concat(F.floor(t / 10 ** digits).cast("string"), F.lit("."), F.lpad((t % 10 ** digits).cast("string"), digits, "0"))


def fixed_label(v, digits: int = 1, plus: str = "") -> Column:
    """P15 – the number with ``digits`` decimals, rounded half to even on its exact value; a negative one keeps its sign at zero."""
    sign = F.when(col_(v) < 0, F.lit("-")).otherwise(F.lit(plus))
    return F.when(col_(v).isNotNull(), F.concat(sign, _fixed(v, digits)))


def pct_label(v, digits: int = 1) -> Column:
    """P15 – ``12.3%``."""
    return F.concat(fixed_label(v, digits), F.lit("%"))


def signed_label(v) -> Column:
    """P15 – ``+1.2`` / ``-0.4``."""
    return fixed_label(v, 1, "+")


def start_end_label(start, end, g_from: int, g_to: int) -> Column:
    """P15 – ``Gr3=41%  →  Gr8=37%``."""
    return F.concat(F.lit(f"Gr{g_from}="), pct_label(start, 0), F.lit(f"  →  Gr{g_to}="), pct_label(end, 0))


def sign_class(v) -> Column:
    """P16 – ``above`` when >= 0."""
    return F.when(col_(v) >= 0, F.lit("above")).when(col_(v) < 0, F.lit("below"))


def clipped_size(n, fill: int = 20, factor: int = 3, lo: int = 20, hi: int = 800) -> Column:
    """P17 – clip(coalesce(n, fill) * factor, lo, hi)."""
    return F.least(F.greatest(F.coalesce(col_(n), F.lit(fill)) * factor, F.lit(lo)), F.lit(hi)).cast("double")


def finite(v) -> Column:
    """P20 – null and NaN both count as missing."""
    return col_(v).isNotNull() & ~F.isnan(col_(v))
