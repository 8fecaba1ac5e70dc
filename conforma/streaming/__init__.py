"""Streaming statistics."""
