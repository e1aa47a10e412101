"""Relational operators over the operation log and its satellites."""
