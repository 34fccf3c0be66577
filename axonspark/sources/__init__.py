"""Readers and catalogs."""
