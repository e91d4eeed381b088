"""tickloom: market-signal analytics as PySpark DataFrame jobs."""

from tickloom.session import build_session, prepare

__all__ = ["build_session", "prepare"]
