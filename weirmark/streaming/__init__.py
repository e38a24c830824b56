"""Incremental landing and incremental upkeep of the price table."""
