"""Operators on text for language-model training data. Nothing outside this package imports it."""

import importlib
import pkgutil


def query_modules() -> list:
    """The modules of this package that register queries."""
    return [importlib.import_module(f"{__name__}.{m.name}") for m in pkgutil.iter_modules(__path__) if m.name.startswith("q_")]
