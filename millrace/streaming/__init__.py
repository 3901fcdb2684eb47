"""Continuous curation: the steps of :mod:`millrace.operators` on streams."""
from millrace.streaming.feed import curate_available
from millrace.streaming.windows import feed, first_arrivals, window_aggregates

__all__ = ["curate_available", "feed", "first_arrivals", "window_aggregates"]
