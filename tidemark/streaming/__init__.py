"""Streaming counterparts of history features."""

from tidemark.streaming.decay import running_decay, windowed_rates

__all__ = ["running_decay", "windowed_rates"]
