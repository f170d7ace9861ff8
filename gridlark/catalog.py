"""All registered queries: importing the modules of plans registers what they hold."""

import importlib

from .registry import ORACLES, QUERIES

for _module in ("profiling", "features", "evaluation", "comparisons", "boards", "streams"):
    importlib.import_module(f"gridlark.plans.{_module}")

__all__ = ["ORACLES", "QUERIES"]
