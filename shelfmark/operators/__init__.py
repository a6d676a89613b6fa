"""Operators on catalogs of entries and chunks, each from DataFrame to DataFrame."""
