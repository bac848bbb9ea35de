"""Flight-shaped and run-shaped views over the order/line-item star schema and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarmac.schema import CAUSE_COLUMNS, FLIGHT_COLUMNS

# Declared, so that no job has to look into the files first.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(TABLES[table]).parquet(f"{sf_dir}/{table}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation of their customer.

    Orders meet customers and nations before the line items, so the largest table is
    shuffled at most once. Which side is broadcast is left to Spark.
    """
    orders = load(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = load(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "c_nationkey", "c_nationkey % 5 = 0 as strike", "c_nationkey = 7 as closed"
    )
    nations = load(spark, sf_dir, "nation").selectExpr("n_nationkey", "n_name as origin")
    origins = (
        orders.join(customers, F.expr("o_custkey = c_custkey"))
        .join(nations, F.expr("c_nationkey = n_nationkey"))
        .select("o_orderkey", "origin", "strike", "closed")
    )
    # Everything that needs no origin is computed below the join, so that a filter above
    # it is pushed down without repeating these expressions.
    late = "l_quantity * 3 - 30 > 15"
    lines = load(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey",
        "cast(month(l_shipdate) as bigint) as month",
        "l_shipdate as fl_date",
        "concat('C', lpad(cast(l_suppkey % 15 as string), 2, '0')) as op_unique_carrier",
        "cast(l_orderkey as double) as op_carrier_fl_num",
        "concat('D', cast(l_partkey % 40 as string)) as dest",
        "l_quantity * 3 - 30 as dep_minutes",
        "if(l_partkey % 97 <> 0, l_quantity * 3 - 30 + l_partkey % 21 - 14, null) as arr_minutes",
        "substr('ABCD', cast(l_partkey % 4 as int) + 1, 1) as code",
        f"if({late} and l_partkey % 3 = 0, 5d, 0d) as carrier_delay",
        f"if({late} and l_partkey % 11 = 0, 7d, 0d) as weather_delay",
        f"if({late} and l_partkey % 2 = 0, 9d, 0d) as nas_delay",
        f"if({late} and l_partkey % 53 = 0, 3d, 0d) as security_delay",
        f"if({late} and l_partkey % 3 = 1, 11d, 0d) as late_aircraft_delay",
        "l_returnflag = 'R' and l_linenumber = 7 as returned",
        "l_suppkey % 15 = 0 as striking",
        "l_partkey % 97 = 0 as off_route",
        "l_partkey % 89 = 0 as unlogged",
        "l_partkey % 101 = 0 as diverted_code",
        "l_partkey % 13 = 0 as uncoded",
        "case when l_partkey % 211 = 0 then 2L when l_partkey % 223 = 0 then -1L end as odd_flag",
        "case when l_partkey % 5 = 0 then '' when l_partkey % 7 = 0 then 'abc' end as scrawl",
    )
    return lines.join(origins, F.expr("l_orderkey = o_orderkey")).selectExpr(
        "*", "not (returned or (striking and strike) or closed) as flown"
    )


def _flight_columns() -> dict[str, str]:
    """Column definitions over ``_lines``, in the order of the flight table."""
    columns = {c: c for c in FLIGHT_COLUMNS}
    columns["dep_delay"] = "if(flown, dep_minutes, null)"
    columns["arr_delay"] = "if(flown, arr_minutes, null)"
    columns["cancelled"] = "if(flown, 0L, 1L)"
    columns["cancellation_code"] = "if(if(flown, diverted_code, not uncoded), code, null)"
    for c in CAUSE_COLUMNS.values():
        columns[c] = f"if(flown, {c}, 0d)"
    return columns


def _select(lines: DataFrame, columns: dict[str, str]) -> DataFrame:
    return lines.selectExpr(*[f"{definition} as {c}" for c, definition in columns.items()])


def flights_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean flights, one per line item.

    One airport never sees a departure, some cancelled flights have no code, and some flown
    ones have one.
    """
    return _select(_lines(spark, sf_dir), _flight_columns())


def raw_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flights before cleaning.

    Adds ``year`` and ``diverted``, blanks some departure delays, gives the date as text and
    part of the cause minutes as text, missing or unreadable, and has odd and missing flags.
    """
    columns = {"year": "2024L", "diverted": "if(flown and off_route, 1L, 0L)"}
    columns |= _flight_columns()
    columns["fl_date"] = "date_format(fl_date, 'yyyy-MM-dd HH:mm:ss')"
    columns["cancelled"] = "nullif(coalesce(odd_flag, if(flown, 0L, 1L)), -1L)"
    columns["dep_delay"] = "if(flown and (off_route or not unlogged), dep_minutes, null)"
    for c in ("carrier_delay", "weather_delay", "nas_delay"):
        text = f"cast(if(flown, {c}, 0d) as string)"
        columns[c] = f"if(scrawl is null, {text}, nullif(scrawl, ''))"
    return _select(_lines(spark, sf_dir), columns)


def runs_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a run log: views and errors ran in one environment, all others in the other."""
    events = load(spark, sf_dir, "events")
    env = F.when(F.col("event_type").isin("view", "error"), "Locale").otherwise("Cluster")
    techs = F.array(*[F.lit(t) for t in ("Hive", "Spark_SQL", "Spark_Core", "MapReduce")])
    percents = F.array(*[F.lit(p) for p in (10, 25, 50, 75, 100, 150)])
    return events.select(
        F.concat(F.lit("3."), (F.col("user_id") % 3 + 1).cast("string")).alias("analysis"),
        F.get(techs, (F.col("user_id") % 4).cast("int")).alias("tech"),
        F.get(percents, F.hour("ts") % 6).alias("pct"),
        env.alias("env"),
        F.col("value").cast("decimal(12,2)").alias("seconds"),
        F.col("event_id").alias("repeat"),
    )
