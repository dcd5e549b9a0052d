"""Importing this module registers every query."""

from accessgraph.plans import access, checks, movement, names, storage, terrain  # noqa: F401
