"""Contract-migration analytics as Spark DataFrame jobs."""

from tidewright.session import build_session, checkpoint

__all__ = ["build_session", "checkpoint"]
