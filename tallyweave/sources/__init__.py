"""Readers and writers of log formats, and action tables."""
