"""All registered queries: name -> (Spark query, DuckDB SQL or None)."""

from __future__ import annotations

import importlib

MODULES = ["line_cases", "extract_cases", "condition_cases", "merge_cases", "stats_cases", "query_cases", "lookup_cases", "audit_cases", "quality_cases", "store_cases", "stream_cases"]

CASES: dict = {}
for _module in MODULES:
    CASES.update(importlib.import_module(f"suite.{_module}").CASES)


def flagship(spark, sf_dir):
    from suite.extract_cases import primary_from_lines

    return primary_from_lines(spark, sf_dir)
