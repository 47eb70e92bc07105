"""Seasonal-observation analytics as PySpark DataFrame operators."""
