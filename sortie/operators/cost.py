"""Cost roll-up: (service, day, cost DECIMAL) ledger rows to months and services."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def service_months(ledger: DataFrame) -> DataFrame:
    """Cost and share per month and service. Zero costs go, negative ones stay."""
    month = F.trunc("day", "month")
    name = F.coalesce(F.nullif(F.trim("service"), F.lit("")), F.lit("Unknown"))
    by_service = ledger.groupBy(month.alias("month"), name.alias("service")).agg(F.sum("cost").alias("cost"))
    totals = by_service.groupBy("month").agg(F.sum("cost").alias("total"))
    share = F.when(F.col("total") > 0, F.round(F.col("cost").cast("double") / F.col("total").cast("double") * 100.0, 4)).otherwise(0.0)
    return (
        by_service.where(F.col("cost") != 0).join(totals, "month")
        .select("month", "service", "cost", share.alias("share_pct"))
    )


def month_totals(ledger: DataFrame, today: dt.date | None = None, months: int | None = None) -> DataFrame:
    """Total and tax per month; with ``today``, a zero row when the current month has no cost."""
    month = F.trunc("day", "month")
    rows = ledger.groupBy(month.alias("month")).agg(
        F.sum("cost").alias("total"), F.sum(F.when(F.col("service") == "Tax", F.col("cost"))).alias("tax")
    )
    if today is None:
        return rows.withColumn("tax", F.coalesce("tax", F.lit(0)))
    current = dt.date(today.year, today.month, 1)
    first = F.add_months(F.lit(current), -(months or 12))
    kept = rows.where((F.col("month") >= first) & (F.col("month") <= F.lit(current)))
    nothing = F.lit(0).cast(kept.schema["total"].dataType)
    empty = ledger.sparkSession.range(1).select(F.lit(current).alias("month"), nothing.alias("total"), nothing.alias("tax"))
    return (
        kept.unionByName(empty).groupBy("month")
        .agg(F.sum("total").alias("total"), F.coalesce(F.sum("tax"), F.lit(0)).alias("tax"))
        .withColumn("estimated", F.col("month") == F.lit(current))
    )


def daily(ledger: DataFrame, month: dt.date) -> DataFrame:
    return ledger.where(F.trunc("day", "month") == F.lit(month).cast("date")).groupBy("day").agg(F.sum("cost").alias("total"))


def top_services(ledger: DataFrame) -> DataFrame:
    """Services with a positive total, over all months."""
    return ledger.groupBy("service").agg(F.sum("cost").alias("cost")).where(F.col("cost") > 0)


def lowest_price(price_lists: DataFrame) -> DataFrame:
    """Least positive unit price per key from nested price lists (JSON text column ``product``)."""
    terms = F.from_json(
        F.col("product"),
        "terms STRUCT<OnDemand: MAP<STRING, STRUCT<priceDimensions: MAP<STRING, STRUCT<pricePerUnit: MAP<STRING, STRING>>>>>>",
    )
    key = [c for c in price_lists.columns if c != "product"]
    term = price_lists.select(*key, F.explode(F.map_values(terms["terms"]["OnDemand"])).alias("_t"))
    dim = term.select(*key, F.explode(F.map_values("_t.priceDimensions")).alias("_d"))
    usd = F.try_element_at(F.col("_d.pricePerUnit"), F.lit("USD")).try_cast("double")
    return dim.select(*key, usd.alias("usd")).groupBy(*key).agg(F.min(F.when(F.col("usd") > 0, F.col("usd"))).alias("usd_per_hour"))
