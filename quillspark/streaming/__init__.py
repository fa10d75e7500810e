"""Streaming forms of the operators."""

from quillspark.streaming.limiter import limited

__all__ = ["limited"]
