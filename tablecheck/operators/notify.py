"""Notification records per recipient, and delivery figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecheck.functions import scalars as S

# ---- fixed values -------------------------------------------------------------------
EVENT_TYPES = ("validation_completion", "anomaly_scoring_completion", "report_publication")
MAX_RECIPIENTS = 20
MAX_RETRIES = 3
# -------------------------------------------------------------------------------------


def notify_fanout(events: DataFrame, recipients: DataFrame, event_id: Column, at: Column) -> DataFrame:
    """One record per configured recipient of each event's type; types without recipients give none.

    The configuration must hold one row per event type, which bounds it to three rows: that is
    checked before it is broadcast, so a frequent event type is no hot key.
    """
    known = recipients.where(F.col("event_type").isin(*EVENT_TYPES)).select("event_type", "recipients")
    if known.limit(len(EVENT_TYPES) + 1).count() > len(EVENT_TYPES):
        raise ValueError("recipients must hold one row per event type")
    addressed = events.join(F.broadcast(known), "event_type").select(
        event_id.cast("string").alias("event_id"),
        "event_type",
        at.alias("sent_at"),
        F.explode("recipients").alias("recipient"),
    )
    return addressed.select(
        S.stable_id(F.col("event_id"), F.col("event_type"), F.col("recipient")).alias("id"),
        "event_id",
        "event_type",
        "recipient",
        F.lit("sending").alias("status"),
        "sent_at",
        F.lit(0).alias("retry_count"),
    )


def delivery_stats(notifications: DataFrame) -> DataFrame:
    """Per event type and status: how many, mean and highest retry count."""
    retries = F.coalesce("retry_count", F.lit(0))
    return notifications.groupBy("event_type", "status").agg(
        F.count(F.lit(1)).alias("count"),
        F.round(F.avg(retries), 4).alias("avg_retries"),
        F.max(retries).alias("max_retries"),
    )
