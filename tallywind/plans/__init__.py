"""Registered queries with their SQL."""

from tallywind.plans import catalogue, extra, more  # noqa: F401  all register their queries
