"""Imports every query module so the registry is complete."""

from __future__ import annotations

import importlib

from turnstile.plans.registry import ORACLES, QUERIES

MODULES = [
    "turnstile.plans.q_ranking",
    "turnstile.plans.q_daily",
    "turnstile.plans.q_weather",
    "turnstile.plans.q_features",
    "turnstile.plans.q_model",
    "turnstile.plans.q_io",
]


def load() -> tuple[dict, dict]:
    for m in MODULES:
        importlib.import_module(m)
    return QUERIES, ORACLES
