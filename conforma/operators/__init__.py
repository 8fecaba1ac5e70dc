"""Operators on frames and representations."""
