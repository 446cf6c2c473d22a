"""The same functions over streams: all of them are stateless maps."""

from .signals import stream_signals

__all__ = ["stream_signals"]
