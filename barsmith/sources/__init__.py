"""Tapes, JSON feeds, configuration and generators."""
