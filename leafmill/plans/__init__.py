"""Runnable queries: one or more per operator, over the given tables."""

import importlib
import pkgutil


def load_all() -> None:
    """Import every query module so that it registers its queries."""
    for module in pkgutil.iter_modules(__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{__name__}.{module.name}")
