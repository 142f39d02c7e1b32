"""Tidewright operators."""
