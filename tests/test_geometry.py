"""Known answers and invariances of the frame geometry."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograin.functions import geometry as g
from tempograin.operators import geometry as ops

STILL = {j: (0.0, 0.0, 0.0) for j in g.JOINTS} | {
    "thorax": (0, 0, 500), "l_hip": (-100, 0, 0), "r_hip": (100, 0, 0), "l_knee": (-100, 0, -400), "r_knee": (100, 0, -400),
    "l_ankle": (-100, 0, -780), "r_ankle": (100, 0, -780), "l_shoulder": (-150, 0, 450), "r_shoulder": (150, 0, 450)}


def table(spark, frames):
    """frames: list of joint -> (x, y, z)."""
    schema = "frame bigint, " + ", ".join(f"{j} struct<x: double, y: double, z: double>" for j in g.JOINTS)
    return spark.createDataFrame([(i, *[tuple(map(float, f[j])) for j in g.JOINTS]) for i, f in enumerate(frames)], schema)


def sweep(n=46):
    out = []
    for a in np.radians(np.linspace(0, 90, n)):
        out.append({**STILL, "r_ankle": (100, -400 * math.sin(a), -400 - 400 * math.cos(a))})
    return out


def rotated(frames, seed=2, scale=1.0):
    q, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return [{j: tuple(scale * (q @ np.array(p)) + 3.0) for j, p in f.items()} for f in frames]


def knees(spark, frames):
    return [r["knee_r"] for r in ops.sagittal_angles(table(spark, frames)).orderBy("frame").collect()]


def test_known_knee_sweep(spark):
    np.testing.assert_allclose(np.abs(knees(spark, sweep())), np.linspace(0, 90, 46), atol=0.5)


@pytest.mark.parametrize("scale", [0.001, 0.1, 7, 1000])
def test_angles_ignore_rotation_and_scale(spark, scale):
    np.testing.assert_allclose(knees(spark, rotated(sweep(), scale=scale)), knees(spark, sweep()), atol=1e-4)


def test_knee_identity(spark):
    df = ops.segment_angles(table(spark, sweep()), g.const(0, 0, 1))
    gap = df.select(F.max(F.abs(F.abs("knee_from_segments_r") - F.lit(0.0))).alias("m")).first()["m"]
    assert abs(gap - 90) < 1e-6
    flex = [r["knee_r"] for r in ops.sagittal_angles(table(spark, sweep())).orderBy("frame").collect()]
    built = [r["knee_from_segments_r"] for r in df.orderBy("frame").collect()]
    np.testing.assert_allclose(np.abs(flex), np.abs(built), atol=1e-6)


def test_known_segment_angles(spark):
    a, b, c = np.radians([30, -15, 10])
    f = {**STILL, "r_knee": (100, 400 * math.sin(a), -400 * math.cos(a)), "thorax": (0, 500 * math.sin(c), 500 * math.cos(c))}
    f["r_ankle"] = tuple(np.array(f["r_knee"]) + [0, 380 * math.sin(b), -380 * math.cos(b)])
    r = ops.segment_angles(table(spark, [f]), g.const(0, 0, 1)).first()
    np.testing.assert_allclose([r["thigh_r"], r["shank_r"], r["trunk"]], [30, -15, 10], atol=1e-6)


def test_lengths_and_ratios(spark):
    long = ops.lengths(table(spark, [STILL] * 3).withColumn("clip", F.lit(1)))
    model = {r["segment"]: r["length"] for r in ops.body_model(long, ["clip"]).collect()}
    assert model == {"thigh_l": 400, "thigh_r": 400, "shank_l": 380, "shank_r": 380, "pelvis": 200, "trunk": 500}
    ratios = {r["ratio"]: r["value"] for r in ops.length_ratios(ops.body_model(long, ["clip"]), ["clip"]).collect()}
    assert ratios["thigh/pelvis_l"] == 2.0 and len(ratios) == 8


def test_alignment_undoes_a_rigid_motion(spark):
    fitted = ["pelvis", "thorax", "l_hip", "r_hip", "l_shoulder", "r_knee"]
    fixed = table(spark, sweep(5))
    moving = table(spark, rotated(sweep(5))).select("frame", *[F.col(j).alias(f"est_{j}") for j in g.JOINTS])
    out = ops.align(fixed.join(moving, "frame"), fitted, "est_", "")
    worst = out.select(F.max(g.norm(g.sub(g.vec("est_r_ankle_aligned"), g.vec("r_ankle")))).alias("d")).first()["d"]
    assert worst < 1e-6


def test_missing_joint_gives_null_not_a_partial_mean(spark):
    df = table(spark, [STILL]).withColumn("l_hip", F.lit(None).cast("struct<x: double, y: double, z: double>"))
    assert df.select(g.middle("l_hip", "r_hip")[0].alias("x")).first()["x"] is None


def test_near_limb_and_view(spark):
    side = {**STILL, "l_hip": (0, 0, 50), "r_hip": (0, 0, -50)}
    df = table(spark, [side] * 4).withColumn("clip", F.lit(1))
    assert ops.near_limb(df, ["clip"]).first()["near"] == "r"
    assert abs(ops.view_ratio(df, ["clip"]).first()["view_ratio"] - 1.0) < 1e-9
