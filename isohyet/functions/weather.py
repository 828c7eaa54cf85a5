"""Measure rules: ranges, wind components, clamps, bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from isohyet.schemas import DRIZZLE_CUTOFF, ESTIMATE_LIMITS, RAIN_CLASSES, RAIN_LEVELS, RANGE_RULES


def to_number(col) -> Column:
    """Number, or null where the text is no number (ANSI-safe).  NaN counts as null."""
    number = F.col(col).try_cast("double") if isinstance(col, str) else col.try_cast("double")
    return F.when(~F.isnan(number), number)


def apply_ranges(df, rules=RANGE_RULES):
    """Null every reading outside its physical range (limits inclusive, NaN is outside)."""
    def rule(c, low, high):
        tests = [f"NOT isnan({c})"]
        if low is not None:
            tests.append(f"{c} >= {low}D")
        if high is not None:
            tests.append(f"{c} <= {high}D")
        return F.expr(f"CASE WHEN {' AND '.join(tests)} THEN {c} END")

    return df.withColumns({c: rule(c, *rules[c]) for c in rules if c in df.columns})


def wind_u(ws: str, wd: str) -> Column:
    """Eastward component of a wind given by speed and the direction it comes from."""
    return F.expr(f"-{ws} * sin(radians({wd}))")


def wind_v(ws: str, wd: str) -> Column:
    """Northward component."""
    return F.expr(f"-{ws} * cos(radians({wd}))")


def clamp_sql(value: str, low: float | None, high: float | None) -> str:
    """SQL: pull a value into limits; null stays null (greatest/least would fill it)."""
    cases = ""
    if high is not None:
        cases += f" WHEN {value} > {high}D THEN {high}D"
    if low is not None:
        cases += f" WHEN {value} < {low}D THEN {low}D"
    return f"CASE{cases} ELSE {value} END" if cases else value


def clamp_estimate(measure: str, value: str, cutoff: float | None = DRIZZLE_CUTOFF) -> Column:
    """Limits for an estimated measure; rain below ``cutoff`` is no rain."""
    out = clamp_sql(value, *ESTIMATE_LIMITS[measure]) if measure in ESTIMATE_LIMITS else value
    if measure == "rain" and cutoff is not None:
        out = f"CASE WHEN {value} < {cutoff}D THEN 0D ELSE {out} END"
    return F.expr(out)


def repair_extremes(df):
    """Widen tdmax/tdmin to hold td; a null on either side changes nothing."""
    return df.withColumns({
        "tdmax": F.expr("CASE WHEN td > tdmax THEN td ELSE tdmax END"),
        "tdmin": F.expr("CASE WHEN td < tdmin THEN td ELSE tdmin END"),
    })


def rain_band(mm: str, levels=RAIN_LEVELS) -> Column:
    """Index of the highest level reached, -1 below the first, null for null."""
    cases = " ".join(f"WHEN {mm} < {upper}D THEN {i}" for i, upper in enumerate(levels, -1))
    return F.expr(f"CASE {cases} WHEN {mm} >= {levels[-1]}D THEN {len(levels) - 1} END")


def rain_class(mm: str, classes=RAIN_CLASSES) -> Column:
    """Name of the rain class; dry below the first wet bound."""
    cases = " ".join(f"WHEN {mm} < {upper}D THEN '{name}'" for (name, _), (_, upper) in zip(classes, classes[1:]))
    return F.expr(f"CASE {cases} WHEN {mm} IS NOT NULL THEN '{classes[-1][0]}' END")


def missing_names(cols: dict[str, Column]) -> Column:
    """Names of the inputs that are null, as an array in the given order."""
    return F.array_compact(F.array(*[F.when(c.isNull(), F.lit(name)) for name, c in cols.items()]))
