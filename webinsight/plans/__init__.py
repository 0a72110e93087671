"""Registered queries by domain; load() imports all of them."""

import importlib

DOMAINS = ("logs", "visits", "coverage", "campaigns", "urls", "content", "keywords", "streams")


def load():
    """The registry, filled."""
    for name in DOMAINS:
        importlib.import_module(f"{__name__}.{name}")
    from . import registry

    return registry
