"""Crawl rates and page counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkloom.functions.text import round_half_even


def pages_surveyed(pages: DataFrame) -> DataFrame:
    return pages.agg(F.count("*").alias("pages"))


def crawl_rates(opened: DataFrame, gathered: DataFrame, period: str = "hour") -> DataFrame:
    """Links gathered and pages viewed per second since the start, per period.

    ``opened(ts)`` has a row per viewed page, ``gathered(ts, url)`` a row per
    sighting of a link; only the first sighting counts. Rows are counted per
    period before anything is ordered. The running totals then go over periods
    within a day and over days, so the window of one task holds 24 rows or one
    row per day of the crawl.
    """
    firsts = gathered.groupBy("url").agg(F.min("ts").alias("ts"))
    ticks = opened.select("ts", F.lit(1).alias("viewed"), F.lit(0).alias("found")).unionByName(
        firsts.select("ts", F.lit(0).alias("viewed"), F.lit(1).alias("found"))
    )
    per_period = ticks.groupBy(F.date_trunc(period, "ts").alias("period")).agg(
        F.sum("viewed").alias("viewed"), F.sum("found").alias("found"), F.min("ts").alias("first_ts")
    )
    per_period = per_period.withColumn("day", F.to_date("period"))
    earlier = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = per_period.groupBy("day").agg(
        F.sum("viewed").alias("viewed"), F.sum("found").alias("found"), F.min("first_ts").alias("first_ts")
    )
    days = days.select(
        "day",
        F.coalesce(F.sum("viewed").over(earlier), F.lit(0)).alias("viewed_before"),
        F.coalesce(F.sum("found").over(earlier), F.lit(0)).alias("found_before"),
        F.min("first_ts").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)).alias("start"),
    )
    in_day = Window.partitionBy("day").orderBy("period").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("period") + F.expr(f"interval 1 {period}")
    # Through an interval, which does not depend on the session's time zone.
    elapsed = (end - F.col("start")).cast("interval second").cast("decimal(38,6)").cast("double")
    running = per_period.select(
        "day", "period", F.sum("viewed").over(in_day).alias("viewed"), F.sum("found").over(in_day).alias("found")
    ).join(days, "day")
    viewed, found = F.col("viewed") + F.col("viewed_before"), F.col("found") + F.col("found_before")
    return running.select(
        "period",
        viewed.alias("opened_links"),
        found.alias("gathered_links"),
        round_half_even(viewed / elapsed, 2).alias("view_rate"),
        round_half_even(found / elapsed, 2).alias("gather_rate"),
    )
