"""The preprocessing pipeline as one lazy plan: raw counts to an enriched long series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadflow.operators import clean, enrich


def long_series(raw: DataFrame, site_types: list[DataFrame], schools: DataFrame, holidays: DataFrame | None = None, site: str = "NB_SCATS_SITE", date: str = "QT_INTERVAL_COUNT", start: str | None = None, end: str | None = None) -> DataFrame:
    """date, time, site, scat_type, day_type, school_count, Flow for each site, day and slot.

    Wide rows (one for each detector) are cleaned, summed over detectors and unpivoted; the pivot that
    would come between cancels out, so it is skipped.
    """
    flows = clean.flow_columns(raw)
    daily = clean.sum_detectors(clean.clean(raw.withColumn("date", F.col(date).cast("date")), flows), [site, "date"], flows)
    series = clean.long_series(daily, [site, "date"], flows, start, end)
    typed = enrich.look_up(series, site_types, site, "scat_type", F.lit("Unknown"))
    dayed = enrich.day_type(typed, "date", holidays)
    full = enrich.look_up(dayed, [schools], site, "school_count", F.lit(0).cast("long"))
    return full.select("date", "time", site, "scat_type", "day_type", "school_count", F.col("Flow").cast("double").alias("Flow"))
