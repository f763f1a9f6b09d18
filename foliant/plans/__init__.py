"""Queries that bind the operators to tables."""

from foliant.plans import assembly, claims, conflicts, frames, keyword, library, pipelines, records, replies, rows, sampling, search, texts  # noqa: F401
