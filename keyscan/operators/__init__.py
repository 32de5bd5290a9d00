"""Relational operators over ordinal-addressed records."""
