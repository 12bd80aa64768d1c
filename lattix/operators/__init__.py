"""Operators on count records and axes."""
