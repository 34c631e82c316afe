"""Joins, matching, aggregates, series and set operators over DataFrames."""
