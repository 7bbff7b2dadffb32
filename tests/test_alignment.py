"""Alignment of frames against a singular value decomposition frame by frame."""

import numpy as np
from pyspark.sql import functions as F

from tempograin.functions import geometry as g
from tempograin.operators import geometry as ops

FITTED = ["pelvis", "thorax", "l_hip", "r_hip", "r_knee"]


def skeletons(spark, frames, prefix=""):
    """Frames of joints by coordinates; an undefined joint is NULL or NaN."""
    schema = "frame bigint, " + ", ".join(f"{prefix}{j} struct<x: double, y: double, z: double>" for j in g.JOINTS)
    return spark.createDataFrame([(i, *[None if p is None else tuple(map(float, p)) for p in f]) for i, f in enumerate(frames)], schema)


def aligned(spark, moving, fixed, **how):
    df = skeletons(spark, fixed).join(skeletons(spark, moving, "est_"), "frame")
    out = ops.align(df, FITTED, "est_", "", **how).orderBy("frame").collect()
    assert set(out[0].asDict()) == {*df.columns, *[f"est_{j}_aligned" for j in g.JOINTS]}
    return [np.array([list(r[f"est_{j}_aligned"]) for j in g.JOINTS], dtype=float) for r in out]


def by_decomposition(moving, fixed, scale):
    at = [list(g.JOINTS).index(j) for j in FITTED]
    src, dst = (np.array([p if p is not None else [np.nan] * 3 for p in f], dtype=float) for f in (moving, fixed))
    use = [i for i in at if np.isfinite(src[i]).all() and np.isfinite(dst[i]).all()]
    if len(use) < 3:
        return src
    ms, md = src[use].mean(axis=0), dst[use].mean(axis=0)
    u, w, vt = np.linalg.svd((dst[use] - md).T @ (src[use] - ms))
    mirror = np.array([1, 1, np.linalg.det(u) * np.linalg.det(vt)])
    size = (w * mirror).sum() / ((src[use] - ms) ** 2).sum() if scale else 1.0
    return size * (src - ms) @ (u * mirror @ vt).T + md


def random_frames(n, spread=1.0, seed=5):
    return list(np.random.default_rng(seed).normal(size=(n, len(g.JOINTS), 3)) * spread)


def test_random_frames_equal_a_decomposition(spark):
    moving = random_frames(60) + random_frames(20, 1e-4, 6) + random_frames(20, 1e5, 7)
    fixed = random_frames(60, 3.0, 8) + random_frames(20, 1e3, 9) + random_frames(20, 1e-3, 10)
    for scale in (False, True):
        for got, a, b in zip(aligned(spark, moving, fixed, scale=scale), moving, fixed):
            want = by_decomposition(a, b, scale)
            np.testing.assert_allclose(got, want, atol=1e-6 * np.abs(want).max())


def test_size_and_turn_are_recovered(spark):
    fixed = random_frames(12)
    turn, _ = np.linalg.qr(np.random.default_rng(1).normal(size=(3, 3)))
    turn *= np.linalg.det(turn)
    moving = [0.02 * f @ turn.T + 7 for f in fixed]
    for got, want in zip(aligned(spark, moving, fixed, scale=True), fixed):
        np.testing.assert_allclose(got, want, atol=1e-8)
    # A half turn has a quaternion without a real part; no turn and no movement are fixed points.
    half = [f * [-1, -1, 1] for f in fixed]
    for got, want in zip(aligned(spark, half + fixed, fixed + fixed), fixed + fixed):
        np.testing.assert_allclose(got, want, atol=1e-8)


def test_undefined_joints_are_skipped_and_two_are_too_few(spark):
    moving, fixed = random_frames(5), random_frames(5, seed=6)
    at = [list(g.JOINTS).index(j) for j in FITTED]
    moving, fixed = [list(f) for f in moving], [list(f) for f in fixed]
    moving[1][at[0]] = None
    fixed[1][at[3]] = [1.0, np.nan, 2.0]
    for i in at[:2]:
        moving[2][i] = None
    fixed[2][at[4]] = None
    for i in at:
        fixed[3][i] = None
    for scale in (False, True):
        got = aligned(spark, moving, fixed, scale=scale)
        for i in range(5):
            np.testing.assert_allclose(got[i], by_decomposition(moving[i], fixed[i], scale), atol=1e-6)
        np.testing.assert_allclose(got[2], [[np.nan] * 3 if p is None else p for p in moving[2]])


def test_flat_straight_and_mirrored_frames_reach_the_best_fit(spark):
    """Where the rotation is not unique, the distance left is still the least."""
    line = [f * [1, 0, 0] for f in random_frames(6)]
    plane = [f * [1, 1, 0] for f in random_frames(6, seed=2)]
    mirror = [f * [1, 1, -1] for f in random_frames(6, seed=3)]
    cross = [np.resize(np.vstack([np.eye(3), -np.eye(3)]), (len(g.JOINTS), 3))]
    moving = line + plane + mirror + line + cross + [np.ones((len(g.JOINTS), 3))]
    fixed = random_frames(6, seed=4) + plane[::-1] + random_frames(6, seed=3) + [f[:, [1, 2, 0]] for f in line] + [-cross[0]] + random_frames(1)
    at = [list(g.JOINTS).index(j) for j in FITTED]
    for got, a, b in zip(aligned(spark, moving, fixed), moving, fixed):
        want = by_decomposition(a, b, False)
        left, least = (np.square(p[at] - b[at]).sum() for p in (got, want))
        assert abs(left - least) < 1e-6
        gaps = [np.linalg.norm(p[:, None] - p[None], axis=2) for p in (got, a)]
        np.testing.assert_allclose(gaps[0], gaps[1], atol=1e-8)
    sized = aligned(spark, moving[-1:], fixed[-1:], scale=True)
    assert np.isnan(sized[0]).all()


def test_no_python_in_the_plan(spark):
    df = skeletons(spark, random_frames(2)).join(skeletons(spark, random_frames(2), "est_"), "frame")
    plan = ops.align(df, FITTED, "est_", "", scale=True).select(F.col("est_pelvis_aligned"))
    assert "Python" not in plan._jdf.queryExecution().toString()
