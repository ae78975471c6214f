"""Analyst vocabulary. Every table and pattern in this file is a fixed value.

Route catalog, metric dictionary, time windows and scope patterns must be these exact words for
a question to be read the same way everywhere.
"""

from __future__ import annotations

# public code, long name, multi-word aliases
ROUTES = (
    ("004", "Powell/UBC Exchange", ("the 4", "route 4", "powell ubc")),
    ("007", "Nanaimo Station/Dunbar", ("route 7", "nanaimo dunbar")),
    ("009", "Broadway", ("route 9", "broadway 9")),
    ("014", "Hastings/UBC Exchange", ("route 14", "hastings ubc")),
    ("016", "29th Avenue Station/Arbutus", ("route 16",)),
    ("019", "Kingsway", ("route 19",)),
    ("020", "Victoria", ("route 20",)),
    ("025", "King Edward", ("route 25", "king edward")),
    ("049", "49th Avenue", ("route 49", "49th ave", "49th avenue")),
    ("099", "Broadway B-Line", ("route 99", "the 99", "99 b-line", "broadway b-line")),
    ("100", "Marine Drive", ("route 100", "marine drive", "marine dr")),
    ("160", "Port Coquitlam Station/Kootenay Loop", ("route 160", "port coquitlam")),
    ("250", "Horseshoe Bay/Dundarave/Vancouver", ("route 250", "horseshoe bay")),
    ("321", "King George Blvd", ("route 321", "king george")),
    ("335", "Newton Exchange/Surrey Central Station", ("route 335", "surrey central")),
    ("410", "Brighouse Station/22nd St Station", ("route 410", "22nd st")),
    ("502", "Fraser Hwy", ("route 502", "fraser hwy 502")),
    ("503", "Fraser Hwy Express", ("route 503", "fraser hwy express")),
    ("R4", "41st Avenue", ("the r4", "route r4", "rapidbus 4", "41st ave", "41st avenue")),
    ("R5", "Hastings St", ("the r5", "route r5", "rapidbus 5", "hastings st")),
)

# name, label, gold table, column, direction, in scope, further phrases
METRICS = (
    ("reliability_score", "Reliability score", "route_reliability_scores", "reliability_score", "higher_is_better", True,
     ("reliability", "how reliable", "reliability rating", "reliable", "unreliable")),
    ("reliability_band", "Reliability band", "route_reliability_scores", "reliability_band", "neutral", True,
     ("band", "reliability category", "status")),
    ("bunching_rate_pct", "Bunching rate (%)", "route_reliability_scores", "bunching_rate_pct", "lower_is_better", True,
     ("bunching", "how much bunching", "bunching percentage", "bunch", "bunched", "bunching rate")),
    ("severe_bunching_rate_pct", "Severe bunching rate (%)", "route_reliability_scores", "severe_bunching_rate_pct",
     "lower_is_better", True, ("severe bunching", "bad bunching rate")),
    ("total_bunching_events", "Total bunching events", "route_reliability_scores", "total_bunching_events",
     "lower_is_better", True, ("bunching events", "number of bunching events", "how many times bunched")),
    ("severe_events", "Severe bunching events", "route_reliability_scores", "severe_events", "lower_is_better", True,
     ("severe events", "serious bunching", "worst bunching incidents")),
    ("peak_bunching_share_pct", "Peak bunching share (%)", "route_reliability_scores", "peak_bunching_share_pct", "neutral",
     True, ("peak share", "how much bunching at peak")),
    ("intervention_priority_score", "Intervention priority score", "corridor_priority_ranking",
     "intervention_priority_score", "higher_is_better", True,
     ("priority", "what to prioritize", "intervention priority", "where to focus", "which corridors to fix",
      "prioritize", "prioritise", "priority corridor", "priority corridors", "intervene")),
    ("hotspot_segments", "Hotspot segments", "corridor_priority_ranking", "hotspot_segments", "lower_is_better", True,
     ("hotspots", "number of hotspots", "problem segments")),
    ("bunching_events_hourly", "Bunching events (hourly)", "hourly_bunching_pattern", "bunching_events", "lower_is_better",
     True, ("bunching by hour", "bunching during peak", "busiest time")),
    ("avg_reliability_score", "Average reliability score (by route type)", "route_type_summary", "avg_reliability_score",
     "higher_is_better", True,
     ("average reliability", "reliability by route type", "how reliable is rapidbus / b-line / regular bus")),
    ("bunching_events_hotspot", "Bunching events (stop-level hotspot)", "bunching_hotspots_with_stops", "bunching_events",
     "lower_is_better", True, ("where does it bunch", "worst segment", "hotspot location", "which stops")),
    ("eligibility_status", "Route data eligibility status", "route_eligibility_summary", "eligibility_status", "neutral",
     False, ("data quality", "trustworthy data", "enough data", "coverage")),
)

# window, aliases
TIME_WINDOWS = (
    ("AM Peak", ("am peak", "morning peak", "morning rush", "am rush", "morning commute")),
    ("PM Peak", ("pm peak", "afternoon peak", "evening rush", "pm rush", "evening commute", "afternoon rush", "rush hour")),
    ("Off Peak", ("off peak", "off-peak", "midday", "non-peak", "evening", "night")),
)

# superlative words by meaning
QUALITY_GOOD = ("best", "strongest")
QUALITY_BAD = ("worst", "poorest", "weakest")
MAGNITUDE_HIGH = ("most", "highest", "top", "greatest", "biggest", "maximum")
MAGNITUDE_LOW = ("least", "lowest", "bottom", "minimum")

# implicit metric cues
PERFORMANCE_CUE = r"\b(perform|performs|performing|performance|do|does|doing)\b"
PEAK_CUE = r"\b(am peak|pm peak|off peak|peak|rush)\b"

# route-shaped text
ROUTE_CUE = r"(?i)\b(?:route|bus|line|the)\s+([a-z]?\d{1,3}[a-z]?)\b"
ROUTE_CODE = r"(?i)\b([a-z]?\d{1,3})\b"

# out-of-scope patterns
RIDERSHIP = (r"\b(ridership|riders?|passengers?|boardings?|how many people|how busy|crowding|load factor|occupancy)\b")
NON_BUS = (r"\b(skytrain|sky train|seabus|sea bus|west coast express|wce|handydart|ferry|expo line|millennium line|"
           r"canada line|train)\b")
ON_TIME = (r"\b(on[\s-]?time|schedule adherence|against schedule|vs schedule|versus schedule|punctual(ity)?|"
           r"delay(ed|s)?\b(?!.*bunch))\b")
SCHEDULE_CUE = r"\b(schedule|timetable|on[\s-]?time|punctual)\b"
TREND = (r"\b(trend|over time|over the (past|last)|month(ly|s)?|week(ly|s)?|year(ly|s)?|day[\s-]?over[\s-]?day|"
         r"historically|history|changed? over|since last|compared to (last|previous)|past \d+ (day|week|month|year))\b")

# anchors in expected answers
NUMBER_ANCHOR = r"(\d[\d,]*\.?\d*)(?![\d.]*[A-Za-z])"
ROUTE_ANCHOR = r"\b(R\d+|0\d{2}|\d{3})\b"


def route_phrases() -> list[tuple[str, str]]:
    """(phrase, code) of long names and multi-word aliases, longest first."""
    pairs = {long.lower(): code for code, long, _ in ROUTES}
    for code, _, aliases in ROUTES:
        for a in aliases:
            pairs.setdefault(a, code)
    return sorted(pairs.items(), key=lambda p: (-len(p[0]), p[0]))


def metric_phrases() -> list[tuple[str, str]]:
    """(phrase, metric) longest first; equal lengths keep dictionary order."""
    out, seen = [], set()
    for name, label, _, _, _, _, more in METRICS:
        for phrase in (name.replace("_", " "), label.lower(), *more):
            if phrase not in seen:
                seen.add(phrase)
                out.append((phrase, name))
    return sorted(out, key=lambda p: -len(p[0]))


def gated_phrases() -> list[str]:
    return [p for name, _, _, _, _, ok, more in METRICS if not ok for p in (*more, name.replace("_", " "))]


def time_aliases() -> list[tuple[str, str]]:
    """(alias, window) longest first."""
    pairs = [(a, w) for w, aliases in TIME_WINDOWS for a in aliases]
    return sorted(pairs, key=lambda p: -len(p[0]))
