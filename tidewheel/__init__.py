"""tidewheel: ordered financial series as Spark jobs."""

from tidewheel.timeline import Recipe, Timeline

__all__ = ["Recipe", "Timeline"]
