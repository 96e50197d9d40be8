"""Registers the scalar functions and predicates as Spark SQL functions.

They are SQL functions (``CREATE TEMPORARY FUNCTION ... RETURN expr``): the
optimizer inlines the expression, so a query pays no Python cost.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

_D = "DOUBLE"
_DEFINITIONS = {
    "vf_distance": ("ax DOUBLE, ay DOUBLE, az DOUBLE, bx DOUBLE, by_ DOUBLE, bz DOUBLE", _D, "sqrt((ax-bx)*(ax-bx)+(ay-by_)*(ay-by_)+(az-bz)*(az-bz))"),
    "vf_distance_spherical": (
        "r1 DOUBLE, t1 DOUBLE, p1 DOUBLE, r2 DOUBLE, t2 DOUBLE, p2 DOUBLE",
        _D,
        "sqrt(greatest(0.0D, r1*r1+r2*r2-2.0D*r1*r2*(sin(t1)*sin(t2)*cos(p1-p2)+cos(t1)*cos(t2))))",
    ),
    "vf_in_shell": ("d DOUBLE, r_in DOUBLE, r_out DOUBLE", "BOOLEAN", "r_in >= 0 and r_out >= 0 and r_in <= r_out and d >= r_in and d < r_out"),
    "vf_in_box": (
        "x DOUBLE, y DOUBLE, z DOUBLE, x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE, z0 DOUBLE, z1 DOUBLE",
        "BOOLEAN",
        "x >= x0 and x < x1 and y >= y0 and y < y1 and z >= z0 and z < z1",
    ),
    "vf_cart2sph": ("x DOUBLE, y DOUBLE, z DOUBLE", "STRUCT<r: DOUBLE, theta: DOUBLE, phi: DOUBLE>", "named_struct('r', sqrt(x*x+y*y+z*z), 'theta', atan2(sqrt(x*x+y*y), z), 'phi', atan2(y, x))"),
    "vf_sph2cart": ("r DOUBLE, theta DOUBLE, phi DOUBLE", "STRUCT<x: DOUBLE, y: DOUBLE, z: DOUBLE>", "named_struct('x', r*sin(theta)*cos(phi), 'y', r*sin(theta)*sin(phi), 'z', r*cos(theta))"),
    "vf_dec2theta": ("dec_ DOUBLE", _D, "pi()/2 - radians(dec_)"),
    "vf_ra2phi": ("ra DOUBLE", _D, "radians(ra)"),
    "vf_shell_area": ("r_in DOUBLE, r_out DOUBLE", _D, "case when r_in < 0 or r_out < 0 or r_in > r_out then 0.0D else 4*pi()*(r_out*r_out-r_in*r_in) end"),
    "vf_box_volume": ("x0 DOUBLE, x1 DOUBLE, y0 DOUBLE, y1 DOUBLE, z0 DOUBLE, z1 DOUBLE", _D, "case when x0 > x1 or y0 > y1 or z0 > z1 then 0.0D else (x1-x0)*(y1-y0)*(z1-z0) end"),
}


def register(spark: SparkSession) -> list[str]:
    """Define every ``vf_*`` function in the session; returns their names."""
    for name, (args, kind, body) in _DEFINITIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_DEFINITIONS)
