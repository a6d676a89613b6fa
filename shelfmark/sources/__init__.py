"""Readers of container files into entries and chunks."""
