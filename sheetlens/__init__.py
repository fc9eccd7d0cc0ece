"""sheetlens: automatic analytics for one flat table, computed as Spark jobs."""

from sheetlens.session import build_session, stage

__all__ = ["build_session", "stage"]
