"""Household panel analytics as chainable Spark DataFrame operators."""
