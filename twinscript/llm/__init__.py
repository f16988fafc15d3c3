"""Operators for training-data pipelines; nothing else in the library imports this subpackage."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules

from twinscript.llm._registry import ORACLES, QUERIES

for _module in iter_modules(__path__):
    if not _module.name.startswith("_"):
        import_module(f"{__name__}.{_module.name}")

__all__ = ["ORACLES", "QUERIES"]
