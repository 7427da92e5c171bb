"""Operators on names and texts for corpora; nothing outside this subpackage imports it."""
