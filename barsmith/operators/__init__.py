"""Operators over trade tapes and bars."""
