"""Schemas and readers of the raw zone."""
