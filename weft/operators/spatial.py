"""Places: great-circle distances as column expressions, and a radius search whose bounding box is pushed to the scan."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weft.operators.signals import ID, SCORE

RADIUS = 6_371_000.0


def distance(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Haversine metres."""
    dp, dl = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dp) ** 2 + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dl) ** 2
    return 2 * RADIUS * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def within(docs: DataFrame, doc_id: str, lon: str, lat: str, at: tuple[float, float], metres: float) -> DataFrame:
    """Places within a radius, scored 1 - distance / radius. Latitudes outside the circle's are dropped by the scan; longitudes
    aren't compared, as circles may hold a pole or cross the date line."""
    span = math.degrees(metres / RADIUS)
    x, y = F.lit(float(at[0])), F.lit(float(at[1]))
    some = docs.where(F.col(lat).between(at[1] - span, at[1] + span))
    d = distance(F.col(lon), F.col(lat), x, y)
    return some.select(F.col(doc_id).cast("bigint").alias(ID), d.alias("_d")).where(F.col("_d") <= metres).select(ID, (1 - F.col("_d") / metres).alias(SCORE))
