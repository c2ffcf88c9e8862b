"""Scalar column functions."""

from tidemark.functions.scalar import *  # noqa: F403
