"""Tidewright: a Spark-first engine for sequenced event, tick and workflow data."""
