"""Scans, sinks and file identities."""
