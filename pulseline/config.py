"""Every threshold and weight in one place, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Box:
    lat_min: float = 48.0
    lat_max: float = 50.0
    lon_min: float = -124.0
    lon_max: float = -121.0


@dataclass(frozen=True)
class SpacingRules:
    severe_km: float = 0.10
    high_km: float = 0.25
    moderate_km: float = 0.50
    max_projection_error_m: float = 100.0
    terminal_buffer_km: float = 0.75
    segment_km: float = 0.5


@dataclass(frozen=True)
class ScoreRules:
    rate_weight: float = 1.2
    severe_weight: float = 2.0
    peak_weight: float = 0.10
    bands: tuple = ((85.0, "Reliable"), (70.0, "Watch"), (55.0, "Degraded"))
    lowest_band: str = "Critical"
    priority_rate_weight: float = 1.5
    priority_severe_weight: float = 3.0
    priority_segment_weight: float = 0.05


@dataclass(frozen=True)
class EligibilityRules:
    min_hours: int = 12
    min_observations: int = 1000
    min_valid_pct: float = 95.0
    high_coverage_hours: int = 18
    medium_coverage_hours: int = 10
    stable_cv: float = 0.5
    moderate_cv: float = 1.0


BOX = Box()
SPACING = SpacingRules()
SCORE = ScoreRules()
ELIGIBILITY = EligibilityRules()

EARTH_RADIUS_M = 6371000.0
LOCAL_OFFSET_HOURS = -7
STATIONARY_MPS = 0.5
PERSISTENT_DAYS = 4
OUTLIER_CV = 0.5
CRITICAL_TOP_N = 20
FRESH_MINUTES = 5

PING_COLUMNS = (
    "collection_timestamp", "api_vehicle_timestamp", "entity_id", "vehicle_id", "route_id",
    "trip_id", "latitude", "longitude", "bearing", "speed",
)

# Route type code -> mode name.
MODE_NAMES = {
    1: "SkyTrain",
    2: "West Coast Express",
    3: "Bus",
    4: "SeaBus",
    715: "HandyDART",
}

# Long-name keywords that mark a bus route as feeding a rail station.
STATION_KEYWORDS = (
    "Station", "Stn", "Brighouse", "Surrey Central", "King Edward", "Production Way",
    "Lougheed", "Commercial-Broadway", "Waterfront", "Lonsdale Quay", "Bridgeport", "Joyce",
    "Metrotown", "Edmonds", "Sapperton", "Coquitlam", "Burrard", "Granville", "Main St",
    "Marine Drive", "Oakridge", "Langara", "VCC-Clark", "Renfrew", "Rupert", "Gilmore",
    "Holdom", "Lake City Way", "Sperling", "Burquitlam", "Inlet", "Moody", "Lincoln",
)

# Short names of the express / regional service class.
EXPRESS_REGIONAL = ("503", "502", "250", "160")


@dataclass(frozen=True)
class ScenarioRules:
    """Event-day planning assumptions."""

    # flag column, label, uplift weight
    exposures: tuple = (
        ("bc_place_exposure", "Downtown / BC Place", 0.30),
        ("downtown_exposure", "Downtown core", 0.20),
        ("fan_festival_exposure", "Fan Festival / Hastings", 0.25),
        ("skytrain_connector_exposure", "SkyTrain connector", 0.10),
        ("pm_peak_vulnerability", "Peak-period exposure", 0.15),
        ("existing_reliability_weakness", "Reliability weakness", 0.20),
    )
    pressures: tuple = (
        ("normal_day", 0.00),
        ("fifa_offpeak_match", 0.25),
        ("fifa_pmpeak_match", 0.55),
        ("fifa_knockout_match", 0.80),
    )
    primary: str = "fifa_pmpeak_match"
    relief: float = 0.15
    cap: float = 2.5
    max_penalty: float = 25.0
    high_risk: float = 45.0
    bands: tuple = ((25.0, "Low"), (45.0, "Medium"), (65.0, "High"), (999.0, "Critical"))
    extra_service: tuple = ("R5", "014", "028", "130", "222")
    bc_place: tuple = ("R4", "099", "009", "014", "004", "007", "016", "019", "100")
    downtown: tuple = ("099", "009", "014", "004", "007", "R5", "019", "100")
    festival: tuple = ("R5", "014")

    def pressure(self, name: str) -> float:
        return dict(self.pressures)[name]


SCENARIO = ScenarioRules()
