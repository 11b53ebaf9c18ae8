"""Relational operators over assets, windows and chunks."""
