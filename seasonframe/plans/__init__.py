"""Whole plans: the document load, and the queries over the star-schema tables."""
