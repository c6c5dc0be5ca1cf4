"""Registered queries, their input records and their SQL."""
