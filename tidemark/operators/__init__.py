"""Operators on change streams and table states."""
