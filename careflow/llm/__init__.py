"""Operators and queries for preparing large text corpora. Nothing else in the library imports this package."""
