"""Message-log counts (A13) over ``events``, batch and streaming."""

from __future__ import annotations

import uuid

from quarry.plans.registry import register
from quarry.session import ensure_checkpoint_dir
from quarry.sources.tables import load_table
from quarry.streaming import topics


@register("topic_counts", """
SELECT event_type AS topic, count(*) AS messages FROM events GROUP BY 1""")
def topic_counts(spark, sf_dir):
    """Messages per topic of the log (topic = event_type)."""
    return topics.topic_counts(topics.message_log(load_table(spark, sf_dir, "events")))


@register("topic_totals", """
SELECT count(*) AS messages, count(DISTINCT event_type) AS topics FROM events""")
def topic_totals(spark, sf_dir):
    """Total messages and topics."""
    return topics.totals(topics.message_log(load_table(spark, sf_dir, "events")))


@register("topic_counts_stream", """
SELECT event_type AS topic, count(*) AS messages FROM events GROUP BY 1""")
def topic_counts_stream(spark, sf_dir):
    """A13 as a Structured Streaming query over the events parquet, run to
    completion (available-now trigger) into a checkpointed table."""
    once = f"{ensure_checkpoint_dir(spark).rstrip('/')}/topic_counts/{uuid.uuid4().hex}"
    return topics.stream_topic_counts(spark, sf_dir, once, file_glob="events.parquet")
