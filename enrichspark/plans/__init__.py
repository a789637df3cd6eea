"""Registered queries over the driver tables and their SQL counterparts."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module of this package, which registers its queries."""
    for info in sorted(pkgutil.iter_modules(__path__), key=lambda m: m.name):
        if info.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{info.name}")
