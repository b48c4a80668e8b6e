"""Structured Streaming forms of stateless scoring and windowed aggregation."""
from .windows import stream_scores, stream_window_stats

__all__ = ["stream_scores", "stream_window_stats"]
