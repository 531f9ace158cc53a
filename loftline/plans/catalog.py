"""Loads every plan module and hands out the register."""

from __future__ import annotations

import importlib

from loftline.plans import registry

MODULES = ("shots", "rounds", "learning", "review", "strokes", "merges", "spatial", "ingest")


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"loftline.plans.{m}_plans")


def queries():
    _load()
    return registry.runners()


def oracles():
    _load()
    return dict(registry.ORACLES)
