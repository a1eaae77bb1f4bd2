"""The logical tables of the product, derived from the given tables.

Each role exists twice: as a DataFrame and as the SQL of the same derivation,
so that a query and its check start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agoradesk.sources.tables import read_table

NOW = "2024-01-31 00:00:00"

SQL = {
    "institutions": """institutions as (select cast(n_nationkey as bigint) institution_id, n_name label,
        n_nationkey % 7 <> 3 active from nation)""",
    "users": """users as (select c_custkey user_id, cast(c_nationkey as bigint) institution_id, c_name display_name,
        c_acctbal >= 0 active, case when c_custkey % 3 = 0 then 'ext-' || c_custkey end external_id,
        c_mktsegment segment from customer)""",
    "devices": """devices as (select o_orderkey device_id, case when o_orderkey % 11 <> 0 then o_custkey end user_id,
        case when o_orderpriority <> '5-LOW' then o_orderdate end activated_at,
        case when o_orderstatus = 'F' then o_orderdate + interval 30 day end revoked_at,
        o_orderdate + interval 10 day last_seen_at from orders)""",
    "memberships": """memberships as (select distinct o_custkey user_id, cast(c_nationkey as bigint) institution_id,
        lower(replace(p_brand, '#', '')) channel_id from lineitem join orders on l_orderkey = o_orderkey
        join customer on c_custkey = o_custkey join part on p_partkey = l_partkey)""",
    "channels": """channels as (select cast(n_nationkey as bigint) institution_id, channel_id,
        'Canal ' || upper(channel_id) label, length(channel_id) % 2 = 0 or channel_id = 'brand1' enabled
        from nation cross join (select distinct lower(replace(p_brand, '#', '')) channel_id from part))""",
}


def with_roles(*names: str) -> str:
    return "with " + ",\n".join(SQL[n] for n in names)


def institutions(spark: SparkSession, sf: str) -> DataFrame:
    n = read_table(spark, sf, "nation")
    return n.select(
        F.col("n_nationkey").cast("long").alias("institution_id"), F.col("n_name").alias("label"),
        (F.col("n_nationkey") % 7 != 3).alias("active"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    c = read_table(spark, sf, "customer")
    return c.select(
        F.col("c_custkey").alias("user_id"), F.col("c_nationkey").cast("long").alias("institution_id"),
        F.col("c_name").alias("display_name"), (F.col("c_acctbal") >= 0).alias("active"),
        F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("ext-"), "c_custkey")).alias("external_id"),
        F.col("c_mktsegment").alias("segment"),
    )


def devices(spark: SparkSession, sf: str) -> DataFrame:
    o = read_table(spark, sf, "orders")
    return o.select(
        F.col("o_orderkey").alias("device_id"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderdate")).alias("activated_at"),
        F.when(F.col("o_orderstatus") == "F", F.expr("o_orderdate + interval 30 days")).alias("revoked_at"),
        F.expr("o_orderdate + interval 10 days").alias("last_seen_at"),
    )


def memberships(spark: SparkSession, sf: str) -> DataFrame:
    line = read_table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    orders = read_table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    part = read_table(spark, sf, "part").select("p_partkey", F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("channel_id"))
    customer = read_table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("institution_id"))
    held = line.join(part, line.l_partkey == part.p_partkey).join(orders, line.l_orderkey == orders.o_orderkey)
    pairs = held.select(F.col("o_custkey").alias("user_id"), "channel_id").distinct()
    return pairs.join(customer, pairs.user_id == customer.c_custkey).select("user_id", "institution_id", "channel_id")


def channels(spark: SparkSession, sf: str) -> DataFrame:
    """Every institution offers the closed list of brands as channels."""
    brands = read_table(spark, sf, "part").select(
        F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))).alias("channel_id")
    ).distinct()
    listed = brands.agg(F.collect_set("channel_id").alias("ids")).withColumn("_k", F.lit(0))
    nation = read_table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("institution_id"), F.lit(0).alias("_k"))
    rows = nation.join(listed, "_k").select("institution_id", F.explode("ids").alias("channel_id"))
    return rows.withColumns(
        {
            "label": F.concat(F.lit("Canal "), F.upper("channel_id")),
            "enabled": (F.length("channel_id") % 2 == 0) | (F.col("channel_id") == "brand1"),
        }
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "events")


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def span(spark: SparkSession, sf: str, table: str, key: str, percent: int = 100):
    """So many percent of the ids of a table, as a modulus for references into it: it grows with the table.

    One number is read when the query is built, so that plans repeat a constant and not a subquery.
    """
    top = read_table(spark, sf, table).agg(F.max(key)).first()[0]
    return F.lit(max(1, ((top or 0) + 1) * percent // 100))
