"""Query modules of the core, imported for their registrations."""

from __future__ import annotations

from importlib import import_module
from pkgutil import iter_modules


def load() -> None:
    for module in iter_modules(__path__):
        import_module(f"{__name__}.{module.name}")
