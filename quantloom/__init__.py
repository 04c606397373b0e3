"""Quantitative equity analytics as Spark DataFrame transformations."""
