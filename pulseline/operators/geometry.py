"""Shape projection, stop references, corridor geometry and map aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from pulseline.functions import columns as C
from pulseline.functions.joins import heavy_keys, spread_join, with_scalars
from pulseline.functions.ordered import ranked_neighbours
from pulseline.functions.quantiles import exact_percentiles
from pulseline.session import stored

CELL_DEG = 0.005  # about 550 m north-south


def _cell(c: str, size: float):
    return F.floor(F.col(c) / F.lit(size)).cast("long")


def project_to_shape(
    pings: DataFrame, shapes: DataFrame, cell_deg: float = CELL_DEG
) -> DataFrame:
    """Nearest vertex of the ping's own shape: distance along shape, sequence, error in metres.

    Exact for every ping, without pairing each ping with each vertex of its shape:

    1. Both sides shrink to distinct locations first. A parked or hot vehicle is one location;
       coincident vertices keep their smallest sequence, which is the tie rule.
    2. Vertices are copied into their 3 x 3 neighbouring cells and joined on (shape, cell). A
       match closer than the block's guaranteed radius is final.
    3. Locations left over (far from their shape) are compared with the shape's occupied cells,
       whose bounding boxes give a lower and an upper bound. Only vertices of cells that can
       still win are measured.

    Shapes with a large share of the locations, and locations with a large share of the pings, are
    dealt over many tasks on both sides of a join (`spread_join`). Pings whose shape has no vertices
    are dropped.
    """
    where = ["shape_id", "latitude", "longitude"]
    known = pings.where(F.col("shape_id").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    places = stored(known.groupBy(*where).agg(F.count(F.lit(1)).alias("n")), "locations")
    hot_shapes, hot_places = heavy_keys(places.select("shape_id", F.lit(1).alias("n")), ["shape_id"]), heavy_keys(places, where)
    points = places.select(*where, _cell("latitude", cell_deg).alias("cy"), _cell("longitude", cell_deg).alias("cx"))
    vertices = (
        shapes.groupBy("shape_id", F.col("shape_pt_lat").alias("v_lat"), F.col("shape_pt_lon").alias("v_lon"))
        .agg(F.min(F.struct(F.col("shape_pt_sequence").alias("seq"), F.col("shape_dist_traveled").alias("dist"))).alias("v"))
        .withColumns({"cy": _cell("v_lat", cell_deg), "cx": _cell("v_lon", cell_deg)})
    )
    term = C.haversine_term("latitude", "longitude", "v_lat", "v_lon")

    # near pass -----------------------------------------------------------------------------
    shift = F.array(F.lit(-1), F.lit(0), F.lit(1))
    spread = (
        vertices.withColumn("dy", F.explode(shift)).withColumn("dx", F.explode(shift))
        .select("shape_id", "v_lat", "v_lon", "v",
                (F.col("cy") + F.col("dy")).alias("cy"), (F.col("cx") + F.col("dx")).alias("cx"))
    )
    near_pairs = spread_join(points, spread, ["shape_id", "cy", "cx"], hot_shapes, where).select(*where, "v", term.alias("term"))
    near = near_pairs.groupBy(*where).agg(F.min(F.struct("term", "v")).alias("hit"))
    located = points.join(near, where, "left")
    # Anything outside the block is at least one cell away in latitude or in longitude.
    half = F.radians(F.lit(cell_deg)) / 2
    lat_guard = F.pow(F.sin(half), F.lit(2.0))
    edge_lat = F.least(F.abs(F.col("latitude")) + F.lit(2 * cell_deg), F.lit(90.0))
    lon_guard = F.pow(F.sin(half) * F.cos(F.radians(edge_lat)), F.lit(2.0))
    guard = F.least(lat_guard, lon_guard) * F.lit(1.0 - 1e-9)
    safe = F.col("hit").isNotNull() & (F.col("hit.term") < guard)
    settled = located.where(safe).select(*where, "hit")

    # far pass ------------------------------------------------------------------------------
    open_points = located.where(~F.coalesce(safe, F.lit(False))).select(*where)
    boxes = vertices.groupBy("shape_id", "cy", "cx").agg(
        F.min("v_lat").alias("lat0"), F.max("v_lat").alias("lat1"),
        F.min("v_lon").alias("lon0"), F.max("v_lon").alias("lon1"),
    )
    bounded = spread_join(open_points, boxes, ["shape_id"], hot_shapes, where).select(
        *where, "cy", "cx",
        _box_lower("latitude", "longitude").alias("low"),
        _box_upper("latitude", "longitude").alias("high"),
    )
    limit = bounded.groupBy(*where).agg(F.min("high").alias("limit"))
    live = bounded.join(limit, where).where(F.col("low") <= F.col("limit")).select(*where, "cy", "cx")
    far_pairs = spread_join(live, vertices, ["shape_id", "cy", "cx"], hot_shapes, where).select(*where, "v", term.alias("term"))
    far = far_pairs.groupBy(*where).agg(F.min(F.struct("term", "v")).alias("hit"))

    found = settled.unionByName(far).select(
        *where,
        F.col("hit.v.seq").alias("nearest_shape_sequence"),
        C.term_to_metres("hit.term").alias("projection_error_m"),
        F.col("hit.v.dist").alias("approx_shape_dist_traveled"),
    )
    return spread_join(known, found, where, hot_places, pings.columns)


def _box_lower(lat: str, lon: str):
    """A haversine term no vertex inside the cell's box can undercut (box within one hemisphere side)."""
    gap_lat = F.greatest(F.col("lat0") - F.col(lat), F.col(lat) - F.col("lat1"), F.lit(0.0))
    gap_lon = F.greatest(F.col("lon0") - F.col(lon), F.col(lon) - F.col("lon1"), F.lit(0.0))
    widest = F.greatest(F.abs(F.col("lat0")), F.abs(F.col("lat1")), F.abs(F.col(lat)))
    s_lat = F.sin(F.radians(gap_lat) / 2)
    s_lon = F.sin(F.radians(gap_lon) / 2)
    c = F.cos(F.radians(widest))
    return (s_lat * s_lat + c * c * s_lon * s_lon) * F.lit(1.0 - 1e-9)


def _box_upper(lat: str, lon: str):
    """A haversine term that every vertex inside the cell's box stays below."""
    far_lat = F.greatest(F.abs(F.col("lat0") - F.col(lat)), F.abs(F.col("lat1") - F.col(lat)))
    far_lon = F.greatest(F.abs(F.col("lon0") - F.col(lon)), F.abs(F.col("lon1") - F.col(lon)))
    s_lat = F.sin(F.radians(far_lat) / 2)
    s_lon = F.sin(F.radians(far_lon) / 2)
    return (s_lat * s_lat + s_lon * s_lon) * F.lit(1.0 + 1e-9)


def projection_quality(projected: DataFrame) -> DataFrame:
    head = projected.agg(
        F.count(F.lit(1)).alias("projected_rows"),
        C.rnd(F.avg("projection_error_m")).alias("avg_projection_error_m"),
        C.rnd(F.max("projection_error_m")).alias("max_projection_error_m"),
    )
    mid = exact_percentiles(projected, [], "projection_error_m", {"m": 0.5}).select(
        C.rnd("m").alias("median_projection_error_m")
    )
    return with_scalars(head, mid)


def projection_by_shape(projected: DataFrame) -> DataFrame:
    return projected.groupBy("direction_id", "shape_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count_distinct("vehicle_id").alias("vehicles"),
        C.rnd(F.min("approx_shape_dist_traveled")).alias("min_shape_dist"),
        C.rnd(F.max("approx_shape_dist_traveled")).alias("max_shape_dist"),
    )


def projected_sample(projected: DataFrame, rows: int = 5000) -> DataFrame:
    return projected.orderBy("collection_timestamp", "vehicle_id", "event_id").limit(rows)


# --- stops ----------------------------------------------------------------------------------

def stop_reference(stop_times: DataFrame, trips: DataFrame, stops: DataFrame) -> DataFrame:
    """First sequence and smallest distance of every stop on each (route, direction, shape).

    Stop times collapse to one row per (trip, stop)-free key before the stop names are joined.
    """
    usable = stop_times.where(F.col("shape_dist_traveled").isNotNull()).select(
        "trip_id", "stop_id", "stop_sequence", "shape_dist_traveled"
    )
    keys = trips.select("trip_id", "route_id", "direction_id", "shape_id")
    per_stop = (
        usable.join(keys, "trip_id")
        .groupBy("route_id", "direction_id", "shape_id", "stop_id")
        .agg(F.min("stop_sequence").alias("stop_sequence"), F.min("shape_dist_traveled").alias("stop_dist_km"))
    )
    return per_stop.join(stops.select("stop_id", "stop_name"), "stop_id", "left")


_SHAPE_KEY = ["route_id", "direction_id", "shape_id"]


_STOP = "struct<stop_id:string,stop_name:string,stop_dist_km:double>"


def segment_stops(hotspots: DataFrame, stop_ref: DataFrame, width: float = 0.5) -> DataFrame:
    """Nearest stop at or before each segment's start and at or after its end.

    A two-sided as-of match by one sorted union: every hotspot is placed twice on its shape's
    distance line, between the stops, and looks back from the start mark and ahead from the end
    mark. No pair of stop and hotspot is formed; hotspots and stops are each read once. At equal
    distance a start mark sorts after a stop and an end mark before it, so touching counts.
    """
    # one stop per exact distance: the smallest id
    stops = stop_ref.groupBy(*_SHAPE_KEY, F.col("stop_dist_km").alias("at")).agg(
        F.min(F.struct("stop_id", "stop_name", "stop_dist_km")).alias("stop")
    )
    rest = [c for c in hotspots.columns if c not in _SHAPE_KEY]
    marks = F.explode(F.array(
        F.struct((F.col("route_segment_km") + F.lit(width)).alias("at"), F.lit(0).alias("side")),
        F.struct(F.col("route_segment_km").alias("at"), F.lit(2).alias("side")),
    ))
    probes = hotspots.select(*_SHAPE_KEY, F.struct(*rest).alias("h"), marks.alias("m")).select(
        *_SHAPE_KEY, "m.at", "m.side", "h", F.lit(None).cast(_STOP).alias("stop")
    )
    h_type = probes.schema["h"].dataType
    line = stops.select(*_SHAPE_KEY, "at", F.lit(1).alias("side"), F.lit(None).cast(h_type).alias("h"), "stop")
    w = Window.partitionBy(*_SHAPE_KEY).orderBy("at", "side")
    back = F.last("stop", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ahead = F.first("stop", ignorenulls=True).over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    seen = line.unionByName(probes).withColumns({"back": back, "ahead": ahead}).where(F.col("h").isNotNull())
    per = seen.groupBy(*_SHAPE_KEY, F.col("h.route_segment_km").alias("k")).agg(
        F.max("h").alias("h"),
        F.max(F.when(F.col("side") == 2, F.col("back"))).alias("b"),
        F.max(F.when(F.col("side") == 0, F.col("ahead"))).alias("a"),
    )
    return per.select(
        *_SHAPE_KEY, *[F.col(f"h.{c}").alias(c) for c in rest],
        F.col("b.stop_id").alias("stop_before_id"), F.col("b.stop_name").alias("stop_before_name"),
        C.rnd("b.stop_dist_km").alias("stop_before_dist_km"),
        F.col("a.stop_id").alias("stop_after_id"), F.col("a.stop_name").alias("stop_after_name"),
        C.rnd("a.stop_dist_km").alias("stop_after_dist_km"),
    )


_SEGMENT = [*_SHAPE_KEY, "route_segment_km"]


def stop_before_segment(hotspots: DataFrame, stop_ref: DataFrame) -> DataFrame:
    """Latest stop at or before the segment start on the same route, direction and shape."""
    found = segment_stops(hotspots.select(*_SEGMENT), stop_ref)
    return found.select(*_SEGMENT, "stop_before_id", "stop_before_name", "stop_before_dist_km")


def stop_after_segment(hotspots: DataFrame, stop_ref: DataFrame, width: float = 0.5) -> DataFrame:
    """Earliest stop at or after the segment end on the same route, direction and shape."""
    found = segment_stops(hotspots.select(*_SEGMENT), stop_ref, width)
    return found.select(*_SEGMENT, "stop_after_id", "stop_after_name", "stop_after_dist_km")


def hotspots_with_stops(hotspots: DataFrame, stop_ref: DataFrame, width: float = 0.5) -> DataFrame:
    return segment_stops(hotspots, stop_ref, width).withColumns({
        "segment_start_km": F.col("route_segment_km"),
        "segment_end_km": F.col("route_segment_km") + F.lit(width),
    })


def route_stop_membership(stop_times: DataFrame, trips: DataFrame, routes: DataFrame | None = None) -> DataFrame:
    """Distinct (route, stop) pairs; optionally only for the given routes.

    The join goes straight into a distinct whose partial step runs before the shuffle.
    """
    keys = trips.select("trip_id", "route_id")
    if routes is not None:
        keys = keys.join(routes.select("route_id"), "route_id", "left_semi")
    return stop_times.select("trip_id", "stop_id").join(keys, "trip_id").select("route_id", "stop_id").distinct()


def stop_counts(membership: DataFrame) -> DataFrame:
    return membership.groupBy("route_id").agg(F.count(F.lit(1)).alias("static_stop_count"))


def representative_shape(trips: DataFrame, shapes: DataFrame) -> DataFrame:
    """The shape with most points among each route's shapes; ties go to the smallest id."""
    points = shapes.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_points"))
    pairs = trips.where(F.col("shape_id").isNotNull()).select("route_id", "shape_id").distinct()
    best = F.min(F.struct((-F.col("n_points")).alias("neg"), "shape_id")).alias("best")
    return pairs.join(points, "shape_id").groupBy("route_id").agg(best).select(
        "route_id", F.col("best.shape_id").alias("shape_id"), (-F.col("best.neg")).alias("n_points")
    )


def corridor_geometry(representative: DataFrame, shapes: DataFrame) -> DataFrame:
    """Points of the representative shapes; one row per point, sequence kept for the drawer."""
    owner = representative.groupBy("shape_id").agg(F.max("route_id").alias("route_id"))
    return shapes.join(owner, "shape_id").select(
        "route_id", "shape_id", F.col("shape_pt_sequence").alias("sequence"),
        F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"),
    )


def critical_corridors(
    buses: DataFrame, membership: DataFrame, representative: DataFrame,
    activity: DataFrame | None = None, top_n: int = 20,
) -> DataFrame:
    """Catalog of bus routes with stop count, shape flag and activity; the busiest are critical."""
    base = (
        buses.join(stop_counts(membership), "route_id", "left")
        .join(representative.select("route_id", F.lit(True).alias("has_shape")), "route_id", "left")
    )
    fill = {"static_stop_count": 0, "has_shape": False}
    order = "static_stop_count"
    if activity is not None:
        fields = ["total_records", "unique_vehicles", "days_active"]
        base = base.join(activity.select("route_id", *fields), "route_id", "left")
        fill |= dict.fromkeys(fields, 0)
        order = "total_records"
    # one row per bus route, so a single ordered partition is small
    rank = F.row_number().over(Window.orderBy(F.desc(order), "route_id")).cast("bigint")
    return (
        base.fillna(fill).withColumn("activity_rank", rank)
        .withColumn("is_critical", F.col("activity_rank") <= top_n)
    )


def top_routes_with_stops(
    catalog: DataFrame, membership: DataFrame, stops: DataFrame, n: int | None = 10,
    subtypes: tuple[str, ...] | None = None, order: str = "total_records",
) -> DataFrame:
    """The n busiest routes (None: all; optionally of some subtypes) and the stops they serve."""
    pool = catalog if subtypes is None else catalog.where(F.col("bus_subtype").isin(*subtypes))
    head = pool if n is None else pool.orderBy(F.desc(order), "route_id").limit(n)
    head = head.select("route_id", "route_short_name", "bus_subtype")
    return membership.join(head, "route_id").join(stops, "stop_id")


def stop_count_distribution(catalog: DataFrame, bins: int = 30) -> DataFrame:
    """Equal-width histogram of stops per route, all routes beside the critical ones."""
    edges = catalog.agg(
        F.min("static_stop_count").cast("double").alias("lo"),
        F.max("static_stop_count").cast("double").alias("hi"),
        C.rnd(F.median("static_stop_count")).alias("median_stops"),
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    slot = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("static_stop_count") - F.col("lo")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1))
    ).cast("int")
    return (
        with_scalars(catalog, edges).withColumn("bin", slot)
        .groupBy("bin", "median_stops")
        .agg(F.count(F.lit(1)).alias("routes"), F.count_if("is_critical").alias("critical_routes"))
    )


def subtype_route_counts(catalog: DataFrame) -> DataFrame:
    return catalog.groupBy("bus_subtype").agg(F.count(F.lit(1)).alias("routes"))


# --- map aggregates --------------------------------------------------------------------------

def density_grid(positions: DataFrame, cell: float = 0.01) -> DataFrame:
    """Point density: rows per grid cell, aggregated map-side before the shuffle."""
    return positions.groupBy(
        F.floor(F.col("latitude") / F.lit(cell)).alias("cell_lat"),
        F.floor(F.col("longitude") / F.lit(cell)).alias("cell_lon"),
    ).agg(F.count(F.lit(1)).alias("points"))


def map_extent(positions: DataFrame) -> DataFrame:
    return positions.agg(
        C.rnd(F.avg("latitude"), 4).alias("centre_lat"), C.rnd(F.avg("longitude"), 4).alias("centre_lon"),
        F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
        F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon"),
    )


def polyline_midpoints(shapes: DataFrame) -> DataFrame:
    """The vertex at index n // 2 of every polyline, where a label is put.

    Ranks come from counted blocks of 4096 sequence numbers, so a very long polyline is not
    sorted in one task.
    """
    blocks = shapes.select("shape_id", "shape_pt_sequence", "shape_pt_lat", "shape_pt_lon").withColumn(
        "block", F.shiftright("shape_pt_sequence", 12)
    )
    ranked = ranked_neighbours(blocks, ["shape_id"], "block", "shape_pt_sequence")
    sizes = shapes.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n"))
    return (
        ranked.join(sizes, "shape_id")
        .where(F.col("rank") == F.floor(F.col("n") / 2) + 1)
        .select("shape_id", F.col("shape_pt_lat").alias("mid_lat"), F.col("shape_pt_lon").alias("mid_lon"))
    )
