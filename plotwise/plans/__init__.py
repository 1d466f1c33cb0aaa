"""Bundles of operators that answer one user-level question each."""
