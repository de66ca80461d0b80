"""Checks of configured values: policies are data, and what is out of range is an error."""

from __future__ import annotations

import math


def known_keys(data: dict, known: set[str]) -> None:
    if type(data) is not dict:
        raise ValueError("a policy must be an object")
    if unknown := set(data) - known:
        raise ValueError(f"unknown keys: {sorted(unknown)}")


def number(name: str, value) -> float:
    """A finite number, which a truth value isn't."""
    if isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value):
        raise ValueError(f"{name} must be a finite number")
    return value


def in_range(name: str, value, low: float, high: float) -> None:
    if not low <= number(name, value) <= high:
        raise ValueError(f"{name} must be {low} to {high}")


def truth(name: str, value) -> None:
    if type(value) is not bool:
        raise ValueError(f"{name} must be true or false")
