"""Content-evidence analytics over whole corpora, as PySpark DataFrame jobs."""

from tracelight.thresholds import Thresholds

__all__ = ["Thresholds"]
