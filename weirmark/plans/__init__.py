"""Pipelines composed of the operators: facts, outcomes, mart, discovery and history."""
