"""Streaming entry points of the engine."""
