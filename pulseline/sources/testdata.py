"""Deterministic view of the generic test tables as pings, schedule tables and questions.

`events` become pings, `nation` routes (and `region` routes that no vehicle reports), `orders` trips and questions, `supplier` stops,
`lineitem` stop times, `part` shape vertices. Every binding is a narrow projection of its
table, so column pruning and pushdown reach the Parquet scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseline.functions.joins import with_scalars


class TestTables:
    """Lazy access to the base tables of one folder and to the domain tables bound on them."""

    __test__ = False

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def pings(self) -> DataFrame:
        e = self.base("events")
        ts = F.col("ts").cast("timestamp")
        cents = F.round(F.col("value") * 100).cast("bigint")
        eid, uid = F.col("event_id"), F.col("user_id")

        def coordinate(ok):
            return (
                F.when(eid % 101 == 0, F.lit(None).cast("double"))
                .when(eid % 97 == 0, F.lit(0.0))
                .otherwise(ok)
            )

        floor4 = F.date_trunc("day", ts) + F.make_dt_interval(
            hours=(F.floor(F.hour(ts) / F.lit(4)) * 4).cast("int")
        )
        return e.select(
            "event_id",
            floor4.alias("collection_timestamp"),
            ts.alias("api_vehicle_timestamp"),
            F.concat(F.lit("E"), eid.cast("string")).alias("entity_id"),
            F.when(eid % 103 != 0, F.concat(F.lit("V"), uid.cast("string"))).alias("vehicle_id"),
            ((uid + eid) % 25).cast("string").alias("route_id"),
            (eid * 2).cast("string").alias("trip_id"),
            coordinate(F.lit(49.2) + (cents % 100) / F.lit(1000.0)).alias("latitude"),
            coordinate(F.lit(-123.1) + (uid % 100) / F.lit(1000.0)).alias("longitude"),
            F.when(eid % 7 != 0, F.lit(0.0)).alias("bearing"),
            F.when(F.col("event_type") == "error", F.lit(0.0))
            .otherwise(F.col("value") / F.lit(25.0)).alias("speed"),
            (eid % 2).cast("int").alias("direction_id"),
            F.concat(F.lit("s"), (uid % 10).cast("string")).alias("shape_id"),
            ((cents % 2000) / F.lit(100.0)).alias("bound_dist_km"),
        )

    def routes(self) -> DataFrame:
        k, name = F.col("n_nationkey"), F.col("n_name")
        text = k.cast("string")
        nations = self.base("nation").select("n_nationkey", "n_name", "n_regionkey")
        unseen = self.base("region").select(
            (F.col("r_regionkey") + 25).alias("n_nationkey"), F.col("r_name").alias("n_name"), F.col("r_regionkey").alias("n_regionkey")
        )
        return nations.unionByName(unseen).select(
            text.alias("route_id"),
            F.when(k == 4, F.lit("099"))
            .when(k % 5 == 0, F.concat(F.lit("R"), text))
            .when(k % 7 == 0, F.concat(F.lit("N"), text))
            .otherwise(F.concat(F.lit("5"), F.lpad(text, 2, "0"))).alias("route_short_name"),
            F.when(k % 3 == 0, F.concat(name, F.lit(" Station")))
            .when(k % 4 == 0, F.concat(name, F.lit(" Express")))
            .otherwise(name).alias("route_long_name"),
            F.when(F.col("n_regionkey").isin(0, 1, 2), 3)
            .when(F.col("n_regionkey") == 3, 1).otherwise(4).alias("route_type"),
        )

    def trips(self) -> DataFrame:
        return self.base("orders").select(
            F.col("o_orderkey").cast("string").alias("trip_id"),
            (F.col("o_custkey") % 25).cast("string").alias("route_id"),
            F.col("o_orderstatus").alias("service_id"),
            F.concat(F.lit("s"), (F.col("o_custkey") % 10).cast("string")).alias("shape_id"),
            (F.floor(F.col("o_orderkey") / F.lit(2.0)).cast("int") % 2).alias("direction_id"),
        )

    def stops(self) -> DataFrame:
        k = F.col("s_suppkey")
        return self.base("supplier").select(
            k.cast("string").alias("stop_id"),
            F.col("s_name").alias("stop_name"),
            (F.lit(49.2) + (k % 100) / F.lit(1000.0)).alias("stop_lat"),
            (F.lit(-123.1) + (k % 90) / F.lit(1000.0)).alias("stop_lon"),
        )

    def stop_times(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_orderkey").cast("string").alias("trip_id"),
            F.col("l_suppkey").cast("string").alias("stop_id"),
            F.col("l_linenumber").alias("stop_sequence"),
            ((F.col("l_suppkey") % 200).cast("double") / F.lit(10.0)).alias("shape_dist_traveled"),
        )

    def shapes(self) -> DataFrame:
        part = self.base("part")
        size = part.agg(F.floor(F.count(F.lit(1)) / F.lit(10.0)).alias("__tenth"))
        seq = F.floor(F.col("p_partkey") / F.lit(10.0))
        return with_scalars(part, size).select(
            F.concat(F.lit("s"), (F.col("p_partkey") % 10).cast("string")).alias("shape_id"),
            seq.cast("int").alias("shape_pt_sequence"),
            (F.lit(49.2) + (F.col("p_size") % 50) / F.lit(500.0)).alias("shape_pt_lat"),
            (F.lit(-123.1) + (seq.cast("int") % 100) / F.lit(1000.0)).alias("shape_pt_lon"),
            (seq.cast("double") * F.lit(20.0) / F.col("__tenth")).alias("shape_dist_traveled"),
        )

    def uneven_pings(self) -> DataFrame:
        """Pings of a network with unlike routes: of every five, one reports in two hours of the day
        only, one with two vehicles, and one rarely after the tenth day."""
        kind, event = F.col("route_id").cast("int") % 5, F.col("event_id")
        brief = (kind == 1) & (F.hour("collection_timestamp") > 4)
        rare = (kind == 3) & (F.dayofmonth("collection_timestamp") > 10) & (event % 6 != 0)
        folded = F.when((kind == 2) & F.col("vehicle_id").isNotNull(), F.concat(F.lit("U"), (event % 2).cast("string")))
        kept = self.pings().filter(~F.coalesce(brief, F.lit(False)) & ~F.coalesce(rare, F.lit(False)))
        return kept.withColumn("vehicle_id", F.coalesce(folded, "vehicle_id"))

    def questions(self) -> DataFrame:
        """One analyst question per order, from twelve templates; some name routes by several phrases."""
        named = F.array(*map(F.lit, (
            "Hastings St", "Broadway B-Line", "Kingsway", "marine drive", "King  Edward", "the port coquitlam run")))
        second = F.array(*map(F.lit, (
            "49th Avenue", "41ST AVE Route 4", "Broadway 9/the R7", "the 99 B-Line", "Hastings/UBC Exchange", "king george blvd")))
        k, c = F.col("o_orderkey"), F.col("o_custkey")
        text = (
            F.when(k % 12 == 0, F.concat(F.lit("What was the reliability score of route "),
                                         (c % 25).cast("string"), F.lit("?")))
            .when(k % 12 == 1, "Which routes have the highest bunching rate?")
            .when(k % 12 == 2, "Which routes are least reliable?")
            .when(k % 12 == 3, "Which routes perform worst during PM Peak?")
            .when(k % 12 == 4, F.concat(F.lit("Compare R"), (c % 30).cast("string"), F.lit(" and 099.")))
            .when(k % 12 == 5, "How many passengers ride each day?")
            .when(k % 12 == 6, "Which SkyTrain line is most delayed?")
            .when(k % 12 == 7, "What is the on-time performance against schedule?")
            .when(k % 12 == 8, F.concat(F.lit("How has R"), (c % 30).cast("string"),
                                        F.lit(" changed over the past 6 months?")))
            .when(k % 12 == 9, "Which corridors should operations prioritize in the morning rush?")
            .when(k % 12 == 10, "Worst severe bunching at rush hour?")
            .otherwise(F.concat(F.lit("Is the data quality on "), named[(c % 6).cast("int")], F.lit(" or "),
                                second[F.expr("CAST(o_orderkey DIV 12 % 6 AS INT)")], F.lit(" good enough?")))
        )
        return self.base("orders").select(F.col("o_orderkey").alias("question_id"), text.alias("text"))
