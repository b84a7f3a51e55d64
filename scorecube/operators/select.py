"""Selection operators (F3–F17, F7/P12). Plain predicates so Catalyst pushes them into the Parquet scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C

def level_pred(type_ids) -> Column:
    """F3 – entity level: one type id or a set (school = 7 and 9)."""
    ids = (type_ids,) if isinstance(type_ids, int) else tuple(type_ids)
    return F.col("type_id") == ids[0] if len(ids) == 1 else F.col("type_id").isin(*ids)


def name_contains_pred(col: str, pattern: str, type_ids) -> Column:
    """F6 – case-insensitive regex contains on a name column (null -> false) at a level."""
    return level_pred(type_ids) & F.coalesce(F.col(col).rlike("(?i)" + pattern), F.lit(False))



def subject_pred(test_id: int) -> Column:
    """F5."""
    return F.col("test_id") == test_id




def scored(df: DataFrame) -> DataFrame:
    """F10 – non-suppressed cells only."""
    return df.filter(F.col(C.PCT).isNotNull())


def nonblank(df: DataFrame, col: str) -> DataFrame:
    """F11."""
    return df.filter(F.col(col).isNotNull() & (F.trim(F.col(col)) != ""))


def tag_sides(df: DataFrame, sides: dict, tag: str = "entity", prefilter: Column | None = None) -> DataFrame:
    """Label rows with every named side whose predicate they satisfy, in ONE scan.

    A row matching several sides (e.g. the state selected as the focus) is emitted once per side by
    ``explode`` – never a self join. ``prefilter`` is a pushable superset of the sides (e.g. the levels
    involved) so the Parquet scan can skip row groups the side predicates (regex, OR) cannot.
    """
    if prefilter is not None:
        df = df.filter(prefilter)
    preds = list(sides.values())
    tags = F.array_compact(F.array(*[F.when(p, F.lit(name)) for name, p in sides.items()]))
    return df.filter(reduce(lambda a, b: a | b, preds)).withColumn(tag, F.explode(tags))


def min_points(df: DataFrame, keys, n: int, count_col: str = "n_points") -> DataFrame:
    """F12 – keep partitions (e.g. one cohort of one entity) with at least ``n`` rows."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    return df.withColumn(count_col, F.count(F.lit(1)).over(w)).filter(F.col(count_col) >= n)


def only_if_present(df: DataFrame, witness: DataFrame, keys) -> DataFrame:
    """Keep ``df`` rows only when ``witness`` has rows for the same key (left semi join; F17/Q54-style guards)."""
    return df.join(witness.select(*keys).distinct(), list(keys), "left_semi")


def empty_like(df: DataFrame) -> DataFrame:
    """F17 – the empty result keeping the schema."""
    return df.filter(F.lit(False))


def label_pred(label: str, entity_type: str) -> Column:
    """Q71 / F7 / P12 – the rows of the entity named by a display label, as a predicate that reaches the scan.

    District: ``name (county)``; school: ``school — district (county)``. A name that itself contains `` (`` is cut at the
    first occurrence; the school match ignores the county; a part that the label lacks isn't compared."""
    if entity_type == "State":
        return level_pred(C.TYPE_STATE)
    if entity_type == "District":
        name, _, county = label.partition(" (")
        pred = level_pred(C.TYPE_DISTRICT) & (F.col("district_name") == name.strip(" "))
        county = county.split(" (")[0].rstrip(")")
        return pred & (F.col("county_name") == county) if " (" in label else pred
    if entity_type == "School":
        parts = label.split(" — ")
        pred = level_pred(C.TYPE_SCHOOL) & (F.col("school_name") == parts[0].strip(" "))
        return pred & (F.col("district_name") == parts[1].partition(" (")[0].strip(" ")) if len(parts) > 1 else pred
    return F.lit(False)
