"""Checks of caller arguments, made before anything is planned."""

from __future__ import annotations

DEFAULT_LIMIT = 20
MAX_LIMIT = 100


def check_page(limit: int, offset: int) -> None:
    """A page holds 1 to 100 rows and starts at row 0 or later."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be between 1 and {MAX_LIMIT}, got {limit}")
    if offset < 0:
        raise ValueError(f"offset must not be negative, got {offset}")


def check_not_negative(**values: float | None) -> None:
    for name, value in values.items():
        if value is not None and value < 0:
            raise ValueError(f"{name} must not be negative, got {value}")
