"""Tidewright functions."""
