"""Registered queries over the star-schema tables, each with its SQL counterpart."""

from turnwise.queries import explore, joins, learning, outputs, plies, profiles, text  # noqa: F401
from turnwise.queries.registry import REGISTRY

__all__ = ["REGISTRY"]
