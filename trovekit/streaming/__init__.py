"""Structured Streaming forms of search, code look-up, intake and meters."""

from trovekit.streaming.jobs import (  # noqa: F401
    metric_windows,
    new_candidates,
    search_stream,
    stream_code_join,
)
