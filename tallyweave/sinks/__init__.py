"""Sinks: names of output files, what a format would drop, and exports."""
