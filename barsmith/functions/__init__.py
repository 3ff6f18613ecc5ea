"""Scalar and ordered-fold functions over columns."""
