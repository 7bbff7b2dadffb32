"""Vector expressions. A vector is a triple of Columns; a point column is a struct x, y, z."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]

# Joint order of the 17-point skeleton.
JOINTS = ["pelvis", "r_hip", "r_knee", "r_ankle", "l_hip", "l_knee", "l_ankle", "spine", "thorax", "neck",
          "head", "l_shoulder", "l_elbow", "l_wrist", "r_shoulder", "r_elbow", "r_wrist"]
# Segments by end joints, and the scale-free ratios of segment lengths.
SEGMENTS = {
    "thigh_l": ("l_hip", "l_knee"), "thigh_r": ("r_hip", "r_knee"),
    "shank_l": ("l_knee", "l_ankle"), "shank_r": ("r_knee", "r_ankle"),
    "pelvis": ("l_hip", "r_hip"), "trunk": ("pelvis", "thorax")}
RATIOS = {
    "thigh/shank_l": ("thigh_l", "shank_l"), "thigh/shank_r": ("thigh_r", "shank_r"),
    "thigh/pelvis_l": ("thigh_l", "pelvis"), "thigh/pelvis_r": ("thigh_r", "pelvis"),
    "shank/pelvis_l": ("shank_l", "pelvis"), "shank/pelvis_r": ("shank_r", "pelvis"),
    "trunk/thigh_l": ("trunk", "thigh_l"), "trunk/thigh_r": ("trunk", "thigh_r")}
# Fixed value: population hip-width to trunk-length ratio.
HIP_TO_TRUNK = 0.4663


def vec(name: str) -> Vec:
    return F.col(name)["x"], F.col(name)["y"], F.col(name)["z"]


def const(x: float, y: float, z: float) -> Vec:
    return F.lit(float(x)), F.lit(float(y)), F.lit(float(z))


def point(v: Vec) -> Column:
    return F.struct(v[0].alias("x"), v[1].alias("y"), v[2].alias("z"))


def sub(a: Vec, b: Vec) -> Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def add(a: Vec, b: Vec) -> Vec:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


def times(a: Vec, k) -> Vec:
    return a[0] * k, a[1] * k, a[2] * k


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Vec, floor: float = 1e-9) -> Vec:
    n = F.greatest(norm(a), F.lit(floor))
    return a[0] / n, a[1] / n, a[2] / n


def middle(*names: str) -> Vec:
    """Mean of named points; NULL as soon as one of them is missing."""
    total = vec(names[0])
    for n in names[1:]:
        total = add(total, vec(n))
    return times(total, 1.0 / len(names))


def distance(a: str, b: str) -> Column:
    return norm(sub(vec(a), vec(b)))


def distance_2d(a: Vec, b: Vec) -> Column:
    dx, dy = a[0] - b[0], a[1] - b[1]
    return F.sqrt(dx * dx + dy * dy)


def clamp(x: Column, lo: float = -1.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def plane_angle(v: Vec, forward: Vec, up: Vec) -> Column:
    """Direction of ``v`` inside the plane, degrees from ``up`` towards ``forward``."""
    return F.degrees(F.atan2(dot(v, forward), dot(v, up)))


def azimuth(ratio: Column) -> Column:
    """Camera azimuth in degrees from the apparent hip-to-trunk ratio."""
    return F.degrees(F.acos(clamp(ratio / HIP_TO_TRUNK, 0.0, 1.0)))


def view_from_ratio(ratio: Column) -> Column:
    """sqrt(1 - cos²) for the same ratio: 1 is side-on, 0 is along the axis."""
    c = clamp(ratio / HIP_TO_TRUNK, 0.0, 1.0)
    return F.sqrt(F.greatest(F.lit(0.0), 1.0 - c * c))


def rotation_about(axis: str, degrees: float) -> list[list[float]]:
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    return {"x": [[1, 0, 0], [0, c, -s], [0, s, c]], "y": [[c, 0, s], [0, 1, 0], [-s, 0, c]],
            "z": [[c, -s, 0], [s, c, 0], [0, 0, 1]]}[axis]
