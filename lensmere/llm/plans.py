"""The registered queries of this subpackage: name -> (Spark callable, oracle SQL or None)."""

from __future__ import annotations

import functools
import importlib

from lensmere.llm.shared import prepared

MODULES = ["minhash_query", "chat_query", "mixing_query", "pq_query", "token_edits_query", "pieces_query", "spans_query", "html_query",
           "topk_query", "quality_query", "resampling_query",
           "negatives_query", "suffixes_query"]


def _prepared_first(run):
    @functools.wraps(run)
    def call(spark, sf):
        prepared(spark)
        return run(spark, sf)

    return call


def registry() -> dict:
    out = {}
    for name in MODULES:
        module = importlib.import_module(f"lensmere.llm.{name}")
        out |= {key: (_prepared_first(run), sql) for key, (run, sql) in module.REGISTRY.items()}
    return out
