"""Linking, reconciling and analysing time-stamped activity logs on Spark."""
