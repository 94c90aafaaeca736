"""Registered queries: name -> (callable, SQL text or None)."""

from __future__ import annotations

import importlib

MODULES = ["leads", "web", "reports", "feeds", "plan", "entities", "streams"]


def registered() -> dict:
    out = {}
    for module in MODULES:
        out.update(importlib.import_module(f"leadloom.queries.{module}").QUERIES)
    return out
