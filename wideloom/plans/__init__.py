"""Composed flows and the registered query catalogue."""
