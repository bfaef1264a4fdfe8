"""marklake: saved-content ingestion and extraction as Spark DataFrame jobs."""

from marklake.session import build_session

__all__ = ["build_session"]
