"""Tests on column names; no data is read."""

from __future__ import annotations

# Substrings of a lower-cased column name.
ID_HINTS = ("id", "uuid", "code", "no.", "number")
NOT_A_MEASURE = ("id", "code", "zip", "year", "month", "day", "rank", "index")
NOT_A_SLICER = ("id", "code", "zip", "index")


def _has_any(name: str, parts: tuple[str, ...]) -> bool:
    return any(p in name.lower() for p in parts)


def is_id_name(name: str) -> bool:
    return _has_any(name, ID_HINTS)


def is_measure_name(name: str) -> bool:
    return not _has_any(name, NOT_A_MEASURE)


def is_slicer_name(name: str) -> bool:
    return not _has_any(name, NOT_A_SLICER)


def quoted(name: str) -> str:
    """Back-quoted column reference, safe for dots and spaces."""
    return "`" + name.replace("`", "``") + "`"
