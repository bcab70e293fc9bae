"""Checks of arguments."""

from __future__ import annotations

# Least and greatest accepted value of each argument.
BOUNDS = {
    "limit": (1, 200), "days": (1, 365), "summary_days": (1, 90), "hours": (1, 720), "min_relevance": (0.0, 1.0), "bars": (30, 1000), "risk_days": (60, 1500),
    "listed": (1, 100), "offset": (0, None), "backfill_limit": (1, 500),
}


def check_bound(name: str, value: float, as_: str | None = None) -> None:
    low, high = BOUNDS[name]
    if value < low or (high is not None and value > high):
        raise ValueError(f"{as_ or name} must be from {low} to {high if high is not None else 'any number'}; it is {value}")
