"""Registered queries over the driver tables, with their SQL twins."""

import importlib
import pkgutil


def load():
    """Import every module of registered queries and return the registry."""
    from corpuskit.checks import registry

    for mod in sorted(m.name for m in pkgutil.iter_modules(__path__)):
        importlib.import_module(f"{__name__}.{mod}")
    return registry
