"""Queries over the standard tables, with SQL that other engines can check them against."""
