"""Readers, writers and the row formats of change streams."""
