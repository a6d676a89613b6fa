"""Registered queries: operators applied to the given tables."""

from . import attributes, commands, registry

__all__ = ["attributes", "commands", "registry"]
