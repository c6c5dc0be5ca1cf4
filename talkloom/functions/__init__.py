"""Columns in, columns out."""
