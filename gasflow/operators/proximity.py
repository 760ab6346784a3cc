"""Vessels near pipeline locations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gasflow.functions.columns import require
from gasflow.functions.sizing import lookup_join

KM_PER_DEGREE = 111.0  # rough, the same in both directions
MAX_DISTANCE_KM = 20.0


def locations_of(df: DataFrame, location: str = "loc_name") -> DataFrame:
    """The distinct located points ``loc_name, loc_latitude, loc_longitude`` of an observation table."""
    require(df, location, "latitude", "longitude")
    points = df.select(
        F.col(location).alias("loc_name"),
        F.col("latitude").alias("loc_latitude"),
        F.col("longitude").alias("loc_longitude"),
    )
    return points.na.drop("any", subset=["loc_latitude", "loc_longitude"]).distinct()


def vessels_near_locations(vessels: DataFrame, locations: DataFrame, km: float = MAX_DISTANCE_KM) -> DataFrame:
    """Each vessel position joined to every location less than ``km`` away, in flat degrees.

    ``locations`` comes from ``locations_of``; ``vessels`` may be a stream. Positions meet locations
    through grid cells as wide as the radius, so the join is on equal cells.
    """
    require(vessels, "latitude", "longitude")
    radius = km / KM_PER_DEGREE

    def reach(c: str) -> Column:
        return F.sequence(F.floor((F.col(c) - radius) / radius), F.floor((F.col(c) + radius) / radius))

    cells = locations.withColumn("_row", F.explode(reach("loc_latitude"))).withColumn(
        "_column", F.explode(reach("loc_longitude"))
    )
    placed = vessels.withColumns(
        {"_row": F.floor(F.col("latitude") / radius), "_column": F.floor(F.col("longitude") / radius)}
    )
    met = lookup_join(placed, cells, ["_row", "_column"], "inner")
    north = F.col("latitude") - F.col("loc_latitude")
    east = F.col("longitude") - F.col("loc_longitude")
    return met.filter(north * north + east * east < radius * radius).drop("_row", "_column")


def vessel_summary(vessels: DataFrame, near: DataFrame) -> DataFrame:
    """Positions collected, positions assigned (one per location met) and locations with vessels."""
    collected = vessels.agg(F.count(F.lit(1)).alias("vessels_collected")).scalar()
    return near.agg(
        F.count(F.lit(1)).alias("vessels_assigned"), F.count_distinct("loc_name").alias("locations_with_vessels")
    ).select(collected.alias("vessels_collected"), "vessels_assigned", "locations_with_vessels")
