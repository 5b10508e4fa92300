"""Relational steps: extraction, matching, coverage, ranking."""
