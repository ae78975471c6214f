"""Pure Column functions: no shuffle, no Python at run time, all inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from pulseline.config import (
    EARTH_RADIUS_M, ELIGIBILITY, EXPRESS_REGIONAL, LOCAL_OFFSET_HOURS, MODE_NAMES, SCENARIO,
    SCORE, SPACING, STATION_KEYWORDS, EligibilityRules,
)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: str | Column, digits: int = 2) -> Column:
    """Round half up, as an arithmetic formula that means the same in every SQL engine."""
    scale = float(10 ** digits)
    return F.floor(col(c) * F.lit(scale) + F.lit(0.5)).cast("double") / F.lit(scale)


def grid_avg(c: str | Column, digits: int) -> Column:
    """Mean of values that lie on a decimal grid, summed as whole grid steps.

    The sum is exact, so the result does not depend on how rows are spread over tasks.
    """
    steps = F.round(col(c) * F.lit(float(10 ** digits))).cast("bigint")
    return F.sum(steps).cast("double") / F.nullif(
        F.lit(float(10 ** digits)) * F.count(col(c)).cast("double"), F.lit(0.0)
    )


def ratio(top: str | Column, bottom: str | Column, times: float | None = None) -> Column:
    """top / bottom as double, NULL when the divisor is zero."""
    a = col(top).cast("double")
    if times is not None:
        a = F.lit(float(times)) * a
    return a / F.nullif(col(bottom).cast("double"), F.lit(0.0))


def ladder(value: Column, steps, otherwise: str, op: str = "le") -> Column:
    """A band name chosen by the first threshold the value meets."""
    tests = {
        "le": lambda t: value <= F.lit(t),
        "lt": lambda t: value < F.lit(t),
        "ge": lambda t: value >= F.lit(t),
    }
    return reduce(
        lambda acc, step: acc.when(tests[op](step[0]), F.lit(step[1])),
        steps[1:],
        F.when(tests[op](steps[0][0]), F.lit(steps[0][1])),
    ).otherwise(F.lit(otherwise))


# --- time ---------------------------------------------------------------------------------

def in_zone(ts: str | Column, tz: str = "UTC") -> Column:
    return col(ts) if tz == "UTC" else F.from_utc_timestamp(col(ts), tz)


def local_hour(hour: str | Column, offset: int = LOCAL_OFFSET_HOURS) -> Column:
    return F.pmod(col(hour) + F.lit(offset), F.lit(24)).cast("int")


def epoch_seconds(ts: str | Column) -> Column:
    """Seconds since 1970 with the fraction kept."""
    return F.unix_micros(col(ts).cast("timestamp")) / F.lit(1e6)


def peak_period(hour: Column) -> Column:
    return (
        F.when(hour.between(7, 9), "AM Peak").when(hour.between(15, 18), "PM Peak").otherwise("Off Peak")
    )


# --- space --------------------------------------------------------------------------------

def haversine_term(lat1, lon1, lat2, lon2) -> Column:
    """The monotone inner term of the haversine formula; enough to compare distances."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    dlat = F.sin((b - a) / F.lit(2.0))
    dlon = F.sin((F.radians(col(lon2)) - F.radians(col(lon1))) / F.lit(2.0))
    return dlat * dlat + F.cos(a) * F.cos(b) * dlon * dlon


def term_to_metres(term: str | Column) -> Column:
    return F.lit(2.0 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(col(term), F.lit(1.0))))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return term_to_metres(haversine_term(lat1, lon1, lat2, lon2))


def segment_start(dist: str | Column, width: float = SPACING.segment_km) -> Column:
    return F.floor(col(dist) / F.lit(width)).cast("double") * F.lit(width)


# --- bands --------------------------------------------------------------------------------

def severity(gap: str | Column) -> Column:
    return ladder(
        col(gap),
        ((SPACING.severe_km, "Severe"), (SPACING.high_km, "High"), (SPACING.moderate_km, "Moderate")),
        "Normal",
    )


def reliability_band(score: Column) -> Column:
    return ladder(score, SCORE.bands, SCORE.lowest_band, "ge")


def coverage_band(hours: str | Column) -> Column:
    return ladder(
        col(hours),
        ((ELIGIBILITY.high_coverage_hours, "High Coverage"),
         (ELIGIBILITY.medium_coverage_hours, "Medium Coverage")),
        "Low Coverage", "ge",
    )


def stability_band(cv: str | Column) -> Column:
    return ladder(
        col(cv), ((ELIGIBILITY.stable_cv, "Stable"), (ELIGIBILITY.moderate_cv, "Moderate")), "Volatile"
    )


def eligibility(hours, observations, valid_pct, rules: EligibilityRules = ELIGIBILITY) -> Column:
    ok = (
        (col(hours) >= rules.min_hours)
        & (col(observations) >= rules.min_observations)
        & (col(valid_pct) >= rules.min_valid_pct)
    )
    return F.when(ok, "Eligible").otherwise("Not Eligible")


def risk_band(score: str | Column) -> Column:
    s = col(score)
    return F.when((s < 0) | s.isNull(), "Unknown").otherwise(
        ladder(s, SCENARIO.bands, "Unknown", "lt")
    )


# --- route classes (three rules that disagree on purpose) ------------------------------------

def mode_of(route_type: str | Column) -> Column:
    code = col(route_type)
    pairs = list(MODE_NAMES.items())
    return reduce(
        lambda acc, p: acc.when(code == p[0], p[1]), pairs[1:], F.when(code == pairs[0][0], pairs[0][1])
    ).otherwise("Unknown")


def bus_subtype(short: str | Column, long: str | Column) -> Column:
    """Telemetry rule: rapid, night, b-line, express, community, regular."""
    s, name = F.coalesce(col(short), F.lit("")), F.lower(F.coalesce(col(long), F.lit("")))
    return (
        F.when(s.rlike("^R[0-9]{1,2}$"), "RapidBus")
        .when(s.rlike("^N[0-9]+$"), "NightBus")
        .when(name.contains("b-line") | (s == "099"), "B-Line")
        .when(name.contains("express"), "Express")
        .when(s.rlike("^C[0-9]+$"), "Community Shuttle")
        .otherwise("Regular Bus")
    )


def bus_subtype_static(route_id, short, long, bline_ids=("6641",)) -> Column:
    """Schedule rule: b-line by id, any 5xx short name is express, no community class."""
    s, name = F.coalesce(col(short), F.lit("")), F.lower(F.coalesce(col(long), F.lit("")))
    return (
        F.when(col(route_id).isin(*bline_ids), "B-Line")
        .when(s.rlike("^N[0-9]+$"), "NightBus")
        .when(s.rlike("^R[0-9]+$"), "RapidBus")
        .when(name.contains("express") | s.startswith("5"), "Express")
        .otherwise("Regular Bus")
    )


def route_class(short: str | Column) -> Column:
    """Reliability rule: any R is rapid, 099 is b-line, four listed routes are regional."""
    s = col(short)
    return (
        F.when(s.startswith("R"), "RapidBus")
        .when(s == "099", "B-Line")
        .when(s.isin(*EXPRESS_REGIONAL), "Express / Regional")
        .otherwise("Regular Bus")
    )


def feeder_flag(long: str | Column) -> Column:
    pattern = "(?i)(" + "|".join(STATION_KEYWORDS) + ")"
    return F.coalesce(col(long), F.lit("")).rlike(pattern)


def route_label(short: str | Column, long: str | Column) -> Column:
    return F.concat(F.trim(col(short)), F.lit(" — "), F.trim(col(long)))


def bare_route_code(short: str | Column) -> Column:
    """Leading zeros dropped, unless nothing would remain."""
    return F.coalesce(F.nullif(F.ltrim(col(short), F.lit("0")), F.lit("")), col(short))
