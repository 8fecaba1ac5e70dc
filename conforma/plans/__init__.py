"""Figures and results as tables."""
