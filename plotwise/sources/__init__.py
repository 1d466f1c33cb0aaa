"""Readers for the landed open-data files and writers for the derived tables."""
