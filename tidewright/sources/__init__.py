"""Tidewright sources."""
