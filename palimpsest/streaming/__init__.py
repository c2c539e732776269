"""Streams of items: the same declarations and filters over Structured Streaming."""

from .live import feed, watch

__all__ = ["feed", "watch"]
