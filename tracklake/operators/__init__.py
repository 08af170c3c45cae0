"""Operators on ragged data."""
