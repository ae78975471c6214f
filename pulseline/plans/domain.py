"""The chain of domain tables, declared once and shared.

Tables are lazy; a table used twice in one query is the same sub-plan, so Spark can reuse its
exchange. The `gold_*` tables are the exception: consumers read them several times, so they are
written once to the shared checkpoint folder and read back, as a scheduled pipeline would.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseline.config import EligibilityRules
from pulseline.operators import activity as act
from pulseline.operators import bunching as bun
from pulseline.operators import dimensions as dims
from pulseline.operators import geometry as geo
from pulseline.operators import network as net
from pulseline.operators import scoring as sco
from pulseline.operators import silver as sil
from pulseline.operators import spacing as spc
from pulseline.session import stored
from pulseline.sources.testdata import TestTables

BOUND_SHAPE_KM = 20.0
BOUND_RULES = EligibilityRules(min_hours=5, min_observations=6, min_valid_pct=90.0)
BOUND_ERROR_M = 500.0


class Domain:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.tables = TestTables(spark, folder)

    # sources
    @cached_property
    def pings(self) -> DataFrame:
        return self.tables.pings()

    @cached_property
    def raw_pings(self) -> DataFrame:
        """Pings with only the ten contract columns and the event id."""
        return self.pings.drop("direction_id", "shape_id", "bound_dist_km")

    @cached_property
    def routes(self) -> DataFrame:
        return self.tables.routes()

    @cached_property
    def trips(self) -> DataFrame:
        return self.tables.trips()

    @cached_property
    def stops(self) -> DataFrame:
        return self.tables.stops()

    @cached_property
    def stop_times(self) -> DataFrame:
        return self.tables.stop_times()

    @cached_property
    def shapes(self) -> DataFrame:
        return self.tables.shapes()

    @cached_property
    def questions(self) -> DataFrame:
        return self.tables.questions()

    # silver and foundation
    @cached_property
    def silver(self) -> DataFrame:
        return sil.silver_positions(self.pings)

    @cached_property
    def silver_enriched(self) -> DataFrame:
        return sil.silver_enriched(self.silver.drop("bound_dist_km"), self.trips)

    @cached_property
    def stability_hours(self) -> DataFrame:
        return sco.route_hourly_stability(self.silver)

    @cached_property
    def quality(self) -> DataFrame:
        return sco.route_quality_summary(self.silver)

    @cached_property
    def eligibility(self) -> DataFrame:
        return sco.route_eligibility(self.stability_hours, self.quality)

    @cached_property
    def bound_eligibility(self) -> DataFrame:
        """Eligibility under rules that some bound route-days meet and others do not."""
        return sco.route_eligibility(self.stability_hours, self.quality, BOUND_RULES)

    @cached_property
    def shape_summary(self) -> DataFrame:
        return dims.shape_distance_summary(self.shapes)

    @cached_property
    def route_shapes(self) -> DataFrame:
        return dims.route_shape_summary(self.trips, self.routes, self.shape_summary)

    # spacing and bunching, on the bound distance
    @cached_property
    def placed(self) -> DataFrame:
        return self.silver.withColumnRenamed("bound_dist_km", spc.DIST).withColumn(
            "shape_length_km", F.lit(BOUND_SHAPE_KM)
        )

    @cached_property
    def in_service(self) -> DataFrame:
        return spc.terminal_buffer(self.placed)

    @cached_property
    def network_headways(self) -> DataFrame:
        return spc.observed_headways(self.in_service)

    @cached_property
    def headways(self) -> DataFrame:
        """Corridor form: the bound data has too few vehicles per route and snapshot to bunch."""
        return spc.observed_headways(self.in_service, spc.CORRIDOR_KEYS, ("route_id", "shape_length_km"))

    @cached_property
    def events(self) -> DataFrame:
        return spc.bunching_events(self.headways).withColumn("service_date", F.to_date("collection_timestamp"))

    @cached_property
    def hotspots(self) -> DataFrame:
        return bun.with_route_names(bun.bunching_hotspots(self.events), self.routes)

    @cached_property
    def hourly(self) -> DataFrame:
        return bun.with_route_names(bun.hourly_bunching(self.events), self.routes)

    @cached_property
    def scores(self) -> DataFrame:
        """One row per route over the whole window."""
        return bun.with_route_names(
            sco.reliability_scores(self.headways, ["route_id"]), self.routes
        )

    @cached_property
    def priority(self) -> DataFrame:
        return sco.corridor_priority(self.scores, self.hotspots)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        return stored(df, name)

    @cached_property
    def gold_hotspots(self) -> DataFrame:
        return self.store(self.hotspots, "gold-hotspots")

    @cached_property
    def gold_priority(self) -> DataFrame:
        """Scores and priority per route: every route-grained consumer reads this."""
        return self.store(self.priority, "gold-priority")

    @cached_property
    def gold_both(self) -> DataFrame:
        """Priority computed from stored hotspots, for queries that need both tables."""
        return self.store(sco.corridor_priority(self.scores, self.gold_hotspots), "gold-priority")

    @cached_property
    def stop_ref(self) -> DataFrame:
        return geo.stop_reference(self.stop_times, self.trips, self.stops)

    @cached_property
    def hot_stops(self) -> DataFrame:
        return geo.hotspots_with_stops(self.hotspots, self.stop_ref)

    @cached_property
    def projected(self) -> DataFrame:
        """Stored once: quality, funnel and spacing each read it several times."""
        return self.store(geo.project_to_shape(self.silver.drop("bound_dist_km"), self.shapes), "projected")

    # activity
    @cached_property
    def timed(self) -> DataFrame:
        """Pings with calendar columns of the collection time."""
        return sil.time_columns(self.raw_pings)

    @cached_property
    def uneven_timed(self) -> DataFrame:
        """Pings with calendar columns of the collection time."""
        return sil.time_columns(self.tables.uneven_pings())

    @cached_property
    def reported(self) -> DataFrame:
        """Pings with calendar columns of the vehicle's own report time (24 hours present)."""
        return sil.time_columns(self.raw_pings, "api_vehicle_timestamp")

    @cached_property
    def counts(self) -> DataFrame:
        return act.route_vehicle_counts(self.raw_pings)

    @cached_property
    def activity(self) -> DataFrame:
        return act.route_activity(self.timed)

    @cached_property
    def daily(self) -> DataFrame:
        return act.daily_summary(self.timed)

    @cached_property
    def coverage(self) -> DataFrame:
        return act.route_coverage(self.timed)

    @cached_property
    def stability(self) -> DataFrame:
        return act.route_daily_stability(self.timed)

    @cached_property
    def vehicles(self) -> DataFrame:
        return act.vehicle_activity(self.timed)

    @cached_property
    def heatmap(self) -> DataFrame:
        return act.route_hour_heatmap(self.reported)

    @cached_property
    def dim(self) -> DataFrame:
        return net.route_dimension(self.routes, self.raw_pings)

    @cached_property
    def enriched(self) -> DataFrame:
        return net.enrich_activity(self.activity, self.dim)

    @cached_property
    def profile(self) -> DataFrame:
        return net.subtype_hourly_profile(self.heatmap, self.dim)

    @cached_property
    def stable_scores(self) -> DataFrame:
        return net.stability_score(self.stability, self.dim)

    @cached_property
    def membership(self) -> DataFrame:
        return geo.route_stop_membership(self.stop_times, self.trips, self.buses)

    @cached_property
    def buses(self) -> DataFrame:
        return dims.bus_routes(self.routes)

    @cached_property
    def representative(self) -> DataFrame:
        bus_trips = dims.semi_filter(self.trips, self.buses, "route_id")
        return geo.representative_shape(bus_trips, self.shapes)

    @cached_property
    def corridors(self) -> DataFrame:
        return geo.critical_corridors(self.buses, self.membership, self.representative, self.activity)
