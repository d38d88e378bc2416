"""All registered queries: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import functools
import importlib

from lensmere.session import bounded_batches, ship

MODULES = ["retrieval", "language", "dialogue", "corpora", "assembly", "measures", "ingest", "stored"]


def _shipped_first(run):
    @functools.wraps(run)
    def call(spark, sf):
        ship(spark)
        bounded_batches(spark)
        return run(spark, sf)

    return call


def registry() -> dict:
    out = {}
    for name in MODULES:
        module = importlib.import_module(f"lensmere.plans.{name}")
        for key, (run, sql) in module.REGISTRY.items():
            if key in out:
                raise ValueError(f"query {key} is registered twice")
            out[key] = (_shipped_first(run), sql)
    return out
