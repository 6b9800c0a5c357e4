"""Tallywind: text and document corpora to entity-by-period indicators and early-warning scores, on Spark."""
