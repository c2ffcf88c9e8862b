"""Operators over logs, features, scores and metrics."""
