"""Race tables derived from the star schema.

An order is a race entry, a line item a lap, a nation a circuit, a customer a
driver and a market segment a constructor. All orders of a nation's customers
in one month form a race.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

# Fixed expressions of the mapping.
MONTH = "trunc(cast(o_orderdate AS date), 'month')"
ROUND_ID = f"cast(c_nationkey AS bigint) * 1000000 + year({MONTH}) * 100 + month({MONTH})"
LAP_MS = "floor(l_extendedprice + 0.5D)"
SESSION_MS = "floor(o_totalprice + 0.5D)"


def clock_text(ms: str) -> str:
    """SQL for milliseconds as ``HH:MM:SS.fff``."""
    return (
        f"concat(lpad(({ms}) div 3600000, 2, '0'), ':', lpad(({ms}) div 60000 % 60, 2, '0'), ':', "
        f"lpad(({ms}) div 1000 % 60, 2, '0'), '.', lpad(({ms}) % 1000, 3, '0'))"
    )


class StarDump:
    """The star schema and the race tables; each is built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            self._tables[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._tables[name]

    @cached_property
    def orders(self) -> DataFrame:
        """Orders with their customer and nation."""
        orders, customers = self.table("orders"), self.table("customer")
        customers = customers.join(self.table("nation"), customers.c_nationkey == self.table("nation").n_nationkey)
        return orders.join(customers, orders.o_custkey == customers.c_custkey)

    @cached_property
    def _placed(self) -> DataFrame:
        """Orders with their month and the race they enter."""
        orders, customers = self.table("orders"), self.table("customer")
        return orders.join(customers, orders.o_custkey == customers.c_custkey).selectExpr(
            "o_orderkey",
            "o_custkey",
            "o_orderstatus",
            "o_totalprice",
            "o_orderpriority",
            "c_nationkey",
            f"{MONTH} AS month",
            f"{ROUND_ID} AS round_id",
        )

    @cached_property
    def _rounds(self) -> DataFrame:
        return self._placed.select("round_id", "c_nationkey", "month").distinct()

    @cached_property
    def round(self) -> DataFrame:
        return self._rounds.selectExpr(
            "round_id AS id",
            "cast(c_nationkey AS bigint) AS circuit_id",
            "concat('round ', round_id) AS name",
            "month AS date",
            "if(round_id % 37 = 0, 't', 'f') AS is_cancelled",
        )

    @cached_property
    def session(self) -> DataFrame:
        """A race and two qualifying sessions, these on the day before."""
        kinds = "inline(array(struct(0 AS n, 'R' AS type), struct(1 AS n, 'Q1' AS type), struct(2 AS n, 'Q2' AS type)))"
        return self._rounds.selectExpr("*", kinds).selectExpr(
            "round_id * 10 + n AS id",
            "round_id",
            "type",
            "if(n = 0, month, date_sub(month, 1)) AS date",
            "if((round_id + n) % 41 = 0, 't', 'f') AS is_cancelled",
        )

    @cached_property
    def roundentry(self) -> DataFrame:
        return self._placed.selectExpr("o_orderkey AS id", "round_id", "o_custkey AS team_driver_id")

    @cached_property
    def sessionentry(self) -> DataFrame:
        """Every order enters the race and one of the two qualifying sessions."""
        timed = self._placed.selectExpr("*", f"{clock_text(SESSION_MS)} AS time")
        return timed.selectExpr("*", "explode(array(0, 1)) AS kind").selectExpr(
            "o_orderkey * 2 + kind AS id",
            "round_id * 10 + if(kind = 0, 0, 1 + o_orderkey % 2) AS session_id",
            "o_orderkey AS round_entry_id",
            "CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderstatus = 'P' THEN 'f' ELSE 't' END"
            " AS is_classified",
            "CASE WHEN o_orderpriority <> '4-NOT SPECIFIED'"
            " THEN try_cast(substr(o_orderpriority, 1, 1) AS int) END AS grid",
            "time",
            "cast(o_orderkey % 16 AS int) AS laps_completed",
        )

    @cached_property
    def teamdriver(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS id", "cast(ascii(c_mktsegment) AS bigint) AS team_id", "c_custkey AS driver_id"
        )

    @cached_property
    def driver(self) -> DataFrame:
        """Customers. Every 50th has no birth date, and the country is unrelated
        to the nation of the customer, which is the circuit."""
        customers = self.table("customer").selectExpr("*", "cast(c_custkey * 7 % 25 AS int) AS home")
        nations = self.table("nation")
        return customers.join(nations, customers.home == nations.n_nationkey).selectExpr(
            "c_custkey AS id",
            "lower(c_name) AS reference",
            "n_name AS country_code",
            "CASE WHEN c_custkey % 50 <> 0"
            " THEN date_add(DATE '1960-01-01', cast(c_custkey % 7300 AS int)) END AS date_of_birth",
        )

    @cached_property
    def team(self) -> DataFrame:
        """Market segments, each at home in one of the nations."""
        segments = self.table("customer").select("c_mktsegment").distinct()
        segments = segments.selectExpr("*", "ascii(c_mktsegment) % 25 AS home")
        nations = self.table("nation")
        return segments.join(nations, segments.home == nations.n_nationkey).selectExpr(
            "cast(ascii(c_mktsegment) AS bigint) AS id",
            "lower(c_mktsegment) AS reference",
            "n_name AS country_code",
        )

    @cached_property
    def circuit(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "cast(n_nationkey AS bigint) AS id", "n_name AS reference", "n_name AS country_code"
        )

    @cached_property
    def lap(self) -> DataFrame:
        """Two thirds of the line items are race laps, the rest qualifying laps."""
        return self.table("lineitem").selectExpr(
            "l_orderkey * 2 + if(l_linenumber % 3 = 0, 1, 0) AS session_entry_id",
            "l_linenumber AS number",
            f"{clock_text(LAP_MS)} AS time",
            "if(l_returnflag = 'R', 't', 'f') AS is_deleted",
        )

    @cached_property
    def circuit_type(self) -> DataFrame:
        """Nation and region; one nation in ten has no type."""
        nations, regions = self.table("nation").filter("n_nationkey % 10 <> 9"), self.table("region")
        return nations.join(regions, nations.n_regionkey == regions.r_regionkey).selectExpr(
            "n_name AS circuit", "r_name AS type_circuit"
        )

    @cached_property
    def weather(self) -> DataFrame:
        """Most frequent event type of a day, ties by name, spread over the months.

        Day d of the event month gives the weather of the months number d, d + 31
        and d + 62 after December 1994, so every 31st month has none.
        """
        per_type = self.table("events").selectExpr("dayofmonth(ts) AS day", "event_type")
        per_type = per_type.groupBy("day", "event_type").count()
        top = per_type.selectExpr("day", "struct(-count AS n, event_type) AS top").groupBy("day").agg({"top": "min"})
        return top.selectExpr(
            "explode(array(day, day + 31, day + 62)) AS months", "`min(top)`.event_type AS event_type"
        ).selectExpr(
            "add_months(DATE '1994-12-01', months) AS date",
            "CASE event_type WHEN 'error' THEN 'Rain' WHEN 'click' THEN 'Changeable'"
            " WHEN 'view' THEN 'Very changeable' ELSE 'Dry' END AS weather",
        )

    @cached_property
    def requests(self) -> DataFrame:
        """Orders as prediction requests: some names in other spelling, some unknown."""
        return self.orders.selectExpr(
            "o_orderkey AS request_id",
            "cast(substr(o_orderpriority, 1, 1) AS int) AS qualification_position",
            "cast(o_orderkey % 20 + 50 AS int) AS laps",
            "if(o_orderkey % 13 = 0, upper(c_mktsegment), lower(c_mktsegment)) AS constructor",
            "n_name AS circuit",
            "CASE WHEN o_orderkey % 11 = 0 THEN concat('nobody ', lower(c_name))"
            " WHEN o_orderkey % 3 = 0 THEN concat('  ', upper(c_name), ' ')"
            " ELSE lower(c_name) END AS driver",
            "cast(o_orderdate AS date) AS race_date",
            "CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderkey % 2 AS int) END AS rain",
            "o_totalprice AS score",
        )

    @cached_property
    def finishes(self) -> DataFrame:
        """Every order as a finished car: a true deviation and a predicted score."""
        return self.orders.selectExpr(
            "o_orderkey",
            f"year({MONTH}) AS race_year",
            f"month({MONTH}) AS race_month",
            f"dayofmonth({MONTH}) AS race_day",
            "n_name AS circuit",
            "lower(c_name) AS driver",
            "lower(c_mktsegment) AS constructor",
            "cast(o_orderkey * 7919 % 1009 AS double) AS deviation_from_median",
            "o_totalprice AS score",
        )

    @cached_property
    def scored_events(self) -> DataFrame:
        """Events as labelled predictions: errors told by their value."""
        return self.table("events").selectExpr(
            "cast(event_type = 'error' AS int) AS label",
            "cast(value > 50 AS int) AS prediction",
            "value AS score",
        )


def dump(spark: SparkSession, sf_dir: str) -> StarDump:
    return StarDump(spark, sf_dir)
