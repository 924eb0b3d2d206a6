"""Operators for large text and vector corpora; nothing outside this subpackage imports it."""
