"""Deterministic evidence analytics over extracted document records, on Spark."""
