"""Relational operators over civic records."""
