"""Incremental sync."""
