"""Readers, file routing, text assembly and writers."""
