"""Palimpsest: agent memory on Spark. Records with an owner, a layer and a validity window, a graph, and search over both."""

from ._ship import ship

__all__ = ["ship"]
