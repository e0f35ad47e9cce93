"""Retail unit-price analytics as Spark DataFrame jobs."""
