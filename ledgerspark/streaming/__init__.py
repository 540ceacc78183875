"""The funnel as a stream: monthly counts kept up to date as application files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def funnel_counts(applications: DataFrame, *, delay: str = "45 days") -> DataFrame:
    """A streaming table of applications (application_date, state_code, decision, requested_amount) to counts by 30-day window; an application that comes later than `delay` behind the newest is left out."""
    at = F.col("application_date").cast("timestamp")
    timed = applications.withColumn("at", at).withWatermark("at", delay)
    return timed.groupBy(F.window("at", "30 days").alias("period"), "state_code", "decision").agg(F.count("*").alias("applications"), F.sum("requested_amount").alias("requested_amount")).select(F.col("period.start").alias("period_start"), "state_code", "decision", "applications", "requested_amount")
