"""Registered queries: one for each operator, on chains made from the given tables."""

from . import core, graph, labels, structures  # noqa: F401
