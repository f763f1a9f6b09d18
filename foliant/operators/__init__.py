"""Foliant: operators."""
