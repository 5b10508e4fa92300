"""Queries over the benchmark tables, and their equivalents in plain SQL."""
