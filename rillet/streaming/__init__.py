"""Structured Streaming forms of the stream steps."""

from rillet.streaming.accounts import quota_stream, running_balance_stream
from rillet.streaming.stream import file_arrival_stream, run_available, stream_filter
from rillet.streaming.windows import closed, event_windows, late_rows

__all__ = ["closed", "event_windows", "file_arrival_stream", "late_rows", "quota_stream", "run_available",
           "running_balance_stream", "stream_filter"]
