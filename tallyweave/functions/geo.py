"""Positions on a sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Two services' positions of one dive are the same within this distance, or this many degrees each way.
SAME_M, SAME_DEGREES = 200.0, 5e-6


def distance_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres (haversine)."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def same_position(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Both coordinates within SAME_DEGREES (two nulls agree), or both positions whole and within SAME_M."""

    def close(a: Column, b: Column) -> Column:
        return F.coalesce(F.abs(a - b) <= SAME_DEGREES, a.isNull() & b.isNull())

    return (close(lat1, lat2) & close(lng1, lng2)) | F.coalesce(distance_m(lat1, lng1, lat2, lng2) <= SAME_M, F.lit(False))
