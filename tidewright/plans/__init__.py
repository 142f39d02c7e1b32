"""Tidewright plans."""
