"""Foliant: streaming."""
