"""Geometry as temporary SQL functions: 2-D scalars and a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession

SCALARS = {
    "box_area": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", "(x1 - x0) * (y1 - y0)"),
    "box_margin": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE", "DOUBLE", "2D * (x1 - x0) + 2D * (y1 - y0)"),
    "box_overlaps": ("ax0 DOUBLE, ay0 DOUBLE, ax1 DOUBLE, ay1 DOUBLE, bx0 DOUBLE, by0 DOUBLE, bx1 DOUBLE, by1 DOUBLE", "BOOLEAN", "ax1 >= bx0 AND bx1 >= ax0 AND ay1 >= by0 AND by1 >= ay0"),
    "box_contains": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, px DOUBLE, py DOUBLE", "BOOLEAN", "px BETWEEN x0 AND x1 AND py BETWEEN y0 AND y1"),
    "box_min_dist": ("x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, px DOUBLE, py DOUBLE", "DOUBLE", "sqrt(greatest(x0 - px, 0D, px - x1) * greatest(x0 - px, 0D, px - x1) + greatest(y0 - py, 0D, py - y1) * greatest(y0 - py, 0D, py - y1))"),
    "point_dist": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", "DOUBLE", "sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))"),
    "point_dominates": ("ax DOUBLE, ay DOUBLE, bx DOUBLE, by DOUBLE", "BOOLEAN", "ax <= bx AND ay <= by AND (ax < bx OR ay < by)"),
}


def register(spark: SparkSession, points_view: str | None = None) -> None:
    """Creates the functions; with a view of points (id, x, y) also range_points(x0, y0, x1, y1) as a table."""
    for name, (args, kind, body) in SCALARS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    if points_view:
        spark.sql(
            "CREATE OR REPLACE TEMPORARY FUNCTION range_points(x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE) RETURNS TABLE(id BIGINT, x DOUBLE, y DOUBLE) "
            f"RETURN SELECT id, x, y FROM {points_view} WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
        )
