"""Whole query plans: the derived atlas, its questions, and the registered queries."""
