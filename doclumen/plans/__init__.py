"""Whole jobs built from the operators, and the tables they write."""
