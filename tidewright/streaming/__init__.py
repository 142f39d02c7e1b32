"""Tidewright streaming."""
