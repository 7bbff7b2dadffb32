"""Per-frame geometry on tables of skeleton frames, one struct column per joint.

Frames never meet each other here except where noted, so these plans have no shuffle.
Intermediate vectors are staged as columns to keep the expression trees small.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tempograin.functions import geometry as g
from tempograin.functions.alignment import rotation_and_fit
from tempograin.functions.geometry import cross, dot, point, sub, unit, vec
from tempograin.functions.numeric import ratio, wrap_degrees
from tempograin.operators.ordered import block_window, join_same, quantiles, with_halo


def stage(df: DataFrame, **vectors: g.Vec) -> DataFrame:
    return df.withColumns({name: point(v) for name, v in vectors.items()})


def body_frame(df: DataFrame) -> DataFrame:
    """Add ``_fwd`` and ``_up`` from the trunk and the hip axis of each frame."""
    df = stage(df, _up0=unit(sub(vec("thorax"), vec("pelvis"))), _ml=unit(sub(vec("r_hip"), vec("l_hip"))))
    df = stage(df, _fwd0=cross(vec("_ml"), vec("_up0")))
    df = stage(df, _fwd=unit(vec("_fwd0")))
    df = stage(df, _up1=cross(vec("_fwd"), vec("_ml")))
    return stage(df, _up=unit(vec("_up1"))).drop("_up0", "_fwd0", "_up1", "_ml")


def sagittal_basis(df: DataFrame, up: g.Vec, prefix: str = "_") -> DataFrame:
    """Add forward (anterior-positive) and up inside the plane normal to the hip axis."""
    f, u = f"{prefix}fwd", f"{prefix}up"
    df = stage(df, _ml=unit(sub(vec("r_hip"), vec("l_hip"))), _u=unit(up))
    df = stage(df, _f0=cross(vec("_u"), vec("_ml")))
    df = stage(df, **{f: unit(vec("_f0"))})
    df = stage(df, _u0=cross(vec("_ml"), vec(f)))
    return stage(df, **{u: unit(vec("_u0"))}).drop("_ml", "_u", "_f0", "_u0")


def sagittal_angles(df: DataFrame) -> DataFrame:
    """Hip and knee flexion of both sides in the body's own frame; the ankle is NULL."""
    df = body_frame(df)
    fwd, up = vec("_fwd"), vec("_up")
    for s in ("l", "r"):
        df = df.withColumns({
            f"_t{s}": g.plane_angle(sub(vec(f"{s}_knee"), vec(f"{s}_hip")), fwd, up),
            f"_s{s}": g.plane_angle(sub(vec(f"{s}_ankle"), vec(f"{s}_knee")), fwd, up)})
        df = df.withColumns({
            f"hip_{s}": wrap_degrees(F.col(f"_t{s}") - 180.0),
            f"knee_{s}": wrap_degrees(F.col(f"_s{s}") - F.col(f"_t{s}")),
            f"ankle_{s}": F.lit(None).cast("double")})
    return df.drop("_fwd", "_up", "_tl", "_tr", "_sl", "_sr")


def inclination(a: str, b: str, from_down: bool = True) -> Column:
    """Inclination of a -> b against the staged vertical, anterior-positive."""
    ref = g.times(vec("_up"), -1.0) if from_down else vec("_up")
    return g.plane_angle(sub(vec(b), vec(a)), vec("_fwd"), ref)


def segment_angles(df: DataFrame, up: g.Vec) -> DataFrame:
    """Thigh and shank of both sides, trunk, and the knee rebuilt from the segments."""
    df = sagittal_basis(df, up).withColumn("trunk", inclination("pelvis", "thorax", False))
    for s in ("l", "r"):
        df = df.withColumns({f"thigh_{s}": inclination(f"{s}_hip", f"{s}_knee"),
                             f"shank_{s}": inclination(f"{s}_knee", f"{s}_ankle")})
        df = df.withColumn(f"knee_from_segments_{s}", wrap_degrees(F.col(f"shank_{s}") - F.col(f"thigh_{s}")))
    return df.drop("_fwd", "_up")


def segment_directions(df: DataFrame, segments: dict[str, tuple[str, str]]) -> DataFrame:
    """Direction of each segment in the body's own frame."""
    df = body_frame(df)
    return df.withColumns({n: g.plane_angle(sub(vec(b), vec(a)), vec("_fwd"), vec("_up"))
                           for n, (a, b) in segments.items()}).drop("_fwd", "_up")


def lengths(df: DataFrame) -> DataFrame:
    """Long form: the length of every segment in every frame."""
    entries = F.array(*[F.struct(F.lit(n).alias("segment"), g.distance(a, b).alias("length"))
                        for n, (a, b) in g.SEGMENTS.items()])
    keep = [c for c in df.columns if c not in g.JOINTS]
    return df.select(*keep, F.inline(entries))


def body_model(long_lengths: DataFrame, keys: list[str]) -> DataFrame:
    """Median length of each segment over a clip's frames."""
    return quantiles(long_lengths, [*keys, "segment"], "length", {"length": 0.5})


def length_ratios(model: DataFrame, keys: list[str]) -> DataFrame:
    """Scale-free ratios of median lengths; NULL on a zero denominator."""
    table = F.map_from_entries(F.collect_list(F.struct("segment", "length")))  # six segments
    maps = model.groupBy(*keys).agg(table.alias("_m"))
    rows = F.array(*[F.struct(F.lit(n).alias("ratio"), ratio(F.col("_m")[a], F.col("_m")[b]).alias("value"))
                     for n, (a, b) in g.RATIOS.items()])
    return maps.select(*keys, F.inline(rows))


def near_limb(df: DataFrame, keys: list[str]) -> DataFrame:
    """The limb whose hip is nearer the camera on average."""
    return df.groupBy(*keys).agg(
        F.when(F.avg(F.col("l_hip")["z"]) < F.avg(F.col("r_hip")["z"]), "l").otherwise("r").alias("near"))


def view_ratio(df: DataFrame, keys: list[str]) -> DataFrame:
    """Hip depth separation over hip width, averaged over frames."""
    depth = F.abs(F.col("l_hip")["z"] - F.col("r_hip")["z"])
    return df.groupBy(*keys).agg(
        F.avg(depth / F.greatest(g.distance("l_hip", "r_hip"), F.lit(1e-9))).alias("view_ratio"))


def apparent_ratio() -> Column:
    """Hip separation over trunk length in the image."""
    hips = g.distance_2d(vec("l_hip"), vec("r_hip"))
    trunk = g.distance_2d(g.middle("l_shoulder", "r_shoulder"), g.middle("l_hip", "r_hip"))
    return hips / F.greatest(trunk, F.lit(1e-9))


def estimated_view(df: DataFrame, keys: list[str], min_rows: int = 5) -> DataFrame:
    """Median estimated view ratio; NULL with fewer than ``min_rows`` usable frames."""
    rows = df.select(*keys, g.view_from_ratio(apparent_ratio()).alias("_v"))
    sizes = rows.groupBy(*keys).agg(F.count("_v").alias("n"))
    mid = quantiles(rows, keys, "_v", {"_m": 0.5})
    return sizes.join(mid, keys).select(*keys, "n", F.when(F.col("n") >= min_rows, F.col("_m")).alias("view_ratio"))


def matrix_rows(r: list[list[float]]) -> Column:
    return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in r])


def camera_table(cameras: dict[str, dict]) -> Column:
    """Camera parameters as an array of structs to explode beside the frames."""
    return F.array(*[
        F.struct(F.lit(name).alias("camera"), matrix_rows(c["R"]).alias("R"),
                 F.array(*[F.lit(float(v)) for v in c["t"]]).alias("T"),
                 *[F.lit(float(c[k])).alias(k) for k in ("fx", "fy", "cx", "cy", "k1", "k2")])
        for name, c in cameras.items()])


def project(df: DataFrame, joint: str, cameras: dict[str, dict]) -> DataFrame:
    """Camera coordinates and distorted pixel position of a joint in every camera."""
    seen = df.select("*", F.inline(camera_table(cameras)))
    p = vec(joint)

    def axis(i: int) -> Column:
        row = F.col("R")[i]
        return row[0] * p[0] + row[1] * p[1] + row[2] * p[2] + F.col("T")[i]
    seen = seen.withColumns({"cam_x": axis(0), "cam_y": axis(1), "cam_z": axis(2)})
    depth = F.nullif(F.col("cam_z"), F.lit(0.0))
    seen = seen.withColumns({"_u": F.col("cam_x") / depth, "_w": F.col("cam_y") / depth})
    seen = seen.withColumn("_r2", F.col("_u") * F.col("_u") + F.col("_w") * F.col("_w"))
    f = 1.0 + F.col("k1") * F.col("_r2") + F.col("k2") * F.col("_r2") * F.col("_r2")
    return (seen.withColumn("px", F.col("_u") * f * F.col("fx") + F.col("cx"))
            .withColumn("py", F.col("_w") * f * F.col("fy") + F.col("cy")).drop("_u", "_w", "_r2", "R", "T"))


def camera_tilt(rows: list[g.Vec], up: g.Vec) -> dict[str, Column]:
    """Pitch, roll and total tilt of a camera whose axes are the given row vectors."""
    e = unit(up)
    image_up = g.times(rows[1], -1.0)
    return {"pitch": F.degrees(F.asin(g.clamp(dot(rows[2], e)))),
            "roll": F.degrees(F.asin(g.clamp(dot(rows[0], e)))),
            "tilt": F.degrees(F.acos(g.clamp(dot(image_up, e) / F.greatest(g.norm(image_up) * g.norm(e), F.lit(1e-12)))))}


def level_error(df: DataFrame, true_up: g.Vec, assumed_up: g.Vec) -> DataFrame:
    """Signed in-plane angle from the assumed to the true vertical, per frame."""
    df = sagittal_basis(df, true_up, "_t_")
    df = sagittal_basis(df, assumed_up, "_a_")
    err = g.plane_angle(vec("_a_up"), vec("_t_fwd"), vec("_t_up"))
    return df.withColumn("level_error", err).drop("_t_fwd", "_t_up", "_a_fwd", "_a_up")


def anatomical_frame(static: DataFrame, keys: list[str]) -> DataFrame:
    """Right, up and posterior axes per subject from mean standing positions."""
    used = ["pelvis", "l_ankle", "r_ankle", "l_hip", "r_hip"]
    means = static.groupBy(*keys).agg(*[
        F.struct(*[F.avg(F.col(j)[a]).alias(a) for a in "xyz"]).alias(f"m_{j}") for j in used])
    df = stage(means, up=unit(sub(vec("m_pelvis"), g.middle("m_l_ankle", "m_r_ankle"))))
    df = stage(df, _across=sub(vec("m_r_hip"), vec("m_l_hip")))
    df = stage(df, _level=sub(vec("_across"), g.times(vec("up"), dot(vec("_across"), vec("up")))))
    df = stage(df, right=unit(vec("_level")))
    df = stage(df, posterior=cross(vec("right"), vec("up")))
    return df.select(*keys, "right", "up", "posterior")


def check_frames(moving: DataFrame, frames: DataFrame, keys: list[str], bars: tuple[float, float]) -> DataFrame:
    """Physical checks of a derived frame on data it was not built from."""
    df = moving.join(frames, keys)
    height = dot(sub(vec("pelvis"), vec("r_ankle")), vec("up"))
    behind = dot(sub(vec("spine"), vec("thorax")), vec("posterior"))
    span = dot(sub(vec("r_hip"), vec("l_hip")), vec("right"))
    handed = dot(cross(vec("right"), vec("up")), vec("posterior"))
    out = df.groupBy(*keys).agg(F.avg(height).alias("height"), F.avg(behind).alias("behind"),
                                F.avg(span).alias("span"), F.avg(handed).alias("handed"))
    names = {"pelvis above ankle": F.col("height") > bars[0], "spine behind thorax": F.col("behind") > bars[1],
             "right hip on the right": F.col("span") > 0, "right-handed": F.abs(F.col("handed") - 1) < 1e-6}
    failures = F.array_compact(F.array(*[F.when(~ok, F.lit(n)) for n, ok in names.items()]))
    return out.withColumn("failures", failures)


def trunk_lean(df: DataFrame, keys: list[str], lag: int = 10, min_frames: int = 5) -> DataFrame:
    """Mean and SD of trunk lean along the direction of travel over ``lag`` frames.

    The trunk is taken in the middle of the travel window; z is up.
    """
    thin = df.select(*keys, "frame", F.struct((F.col("pelvis")["x"]).alias("x"), F.col("pelvis")["y"].alias("y")).alias("_p"),
                     point(sub(vec("thorax"), vec("pelvis"))).alias("_t"))
    halo = with_halo(thin, "frame", lag)
    w = block_window(keys, "frame")
    moved = halo.select("*", F.lead("_p", lag).over(w).alias("_q"), F.lead("_t", lag // 2).over(w).alias("_m")).filter(~F.col("_halo"))
    vx, vy = F.col("_q")["x"] - F.col("_p")["x"], F.col("_q")["y"] - F.col("_p")["y"]
    moved = moved.withColumns({"_vx": vx, "_vy": vy}).withColumn("_v", F.sqrt(F.col("_vx") * F.col("_vx") + F.col("_vy") * F.col("_vy")))
    good = moved.filter((F.col("_v") > 1e-3) & F.col("_m").isNotNull())
    along = (F.col("_m")["x"] * F.col("_vx") + F.col("_m")["y"] * F.col("_vy")) / F.col("_v")
    ang = F.degrees(F.atan2(along, F.col("_m")["z"]))
    out = good.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(ang).alias("lean"), F.stddev_samp(ang).alias("lean_sd"))
    return out.withColumns({c: F.when(F.col("n") >= min_frames, F.col(c)) for c in ("lean", "lean_sd")})


def upright_angles(df: DataFrame) -> DataFrame:
    """Pelvic tilt (fore-aft axis above horizontal) and trunk angle, z up.

    The fore-aft axis runs from the spine point to the pelvis point.
    """
    df = stage(df, _ml=unit(sub(vec("r_hip"), vec("l_hip"))))
    df = stage(df, _f0=cross(vec("_ml"), g.const(0, 0, 1)))
    df = stage(df, _f=unit(vec("_f0")))
    axis, trunk = sub(vec("pelvis"), vec("spine")), sub(vec("thorax"), vec("pelvis"))
    up = g.const(0, 0, 1)
    tilt = F.degrees(F.atan2(dot(axis, up), dot(axis, vec("_f"))))
    return df.withColumn("tilt", tilt).withColumn("trunk", g.plane_angle(trunk, vec("_f"), up)).drop("_ml", "_f0", "_f")


def travel_azimuth(df: DataFrame, keys: list[str], centre: tuple[float, float], lag: int = 10,
                   min_frames: int = 5) -> DataFrame:
    """Angle between the sight line and the travel over ``lag`` frames: quartiles per clip."""
    thin = df.select(*keys, "frame", F.col("pelvis")["x"].alias("_x"), F.col("pelvis")["y"].alias("_y"))
    halo = with_halo(thin, "frame", lag)
    w = block_window(keys, "frame")
    m = halo.select("*", F.lead("_x", lag).over(w).alias("_x2"), F.lead("_y", lag).over(w).alias("_y2")).filter(~F.col("_halo"))
    m = m.withColumns({"_vx": F.col("_x2") - F.col("_x"), "_vy": F.col("_y2") - F.col("_y"),
                       "_sx": (F.col("_x2") + F.col("_x")) / 2.0 - centre[0], "_sy": (F.col("_y2") + F.col("_y")) / 2.0 - centre[1]})
    m = m.withColumns({"_v": F.hypot("_vx", "_vy"), "_s": F.hypot("_sx", "_sy")}).filter("_v > 1e-3 and _s > 1e-3")
    cos = F.abs(F.col("_vx") * F.col("_sx") + F.col("_vy") * F.col("_sy")) / (F.col("_v") * F.col("_s"))
    angles = m.select(*keys, F.degrees(F.acos(F.least(F.lit(1.0), cos))).alias("_deg"))
    sizes = angles.groupBy(*keys).agg(F.count("_deg").alias("n"))
    q = quantiles(angles, keys, "_deg", {"p25": 0.25, "deg": 0.5, "p75": 0.75})
    return join_same(sizes, q, keys).select(*keys, "n", *[F.when(F.col("n") >= min_frames, F.col(c)).alias(c) for c in ("deg", "p25", "p75")])


def travel_per_frame(df: DataFrame, keys: list[str], min_frames: int = 3) -> DataFrame:
    """Median signed sideways travel per frame in hip widths (trunk lengths if flat)."""
    thin = df.select(*keys, "frame", F.col("pelvis")["x"].alias("_x"),
                     F.abs(F.col("l_hip")["x"] - F.col("r_hip")["x"]).alias("_hip"),
                     F.abs(F.col("thorax")["y"] - F.col("pelvis")["y"]).alias("_trunk"))
    halo = with_halo(thin, "frame", 1)
    steps = halo.select("*", (F.col("_x") - F.lag("_x", 1).over(block_window(keys, "frame"))).alias("_dx")).filter(~F.col("_halo"))
    sizes = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    mids = sizes
    for c in ("_hip", "_trunk", "_dx"):
        mids = mids.join(quantiles(steps, keys, c, {f"{c}_m": 0.5}), keys)
    scale = F.when(F.col("_hip_m") >= 1e-6, F.col("_hip_m")).when(F.col("_trunk_m") >= 1e-6, F.col("_trunk_m"))
    return mids.select(*keys, "n", F.when(F.col("n") >= min_frames, F.col("_dx_m") / scale).alias("dx_per_frame"))


def excursion(df: DataFrame, keys: list[str]) -> DataFrame:
    """Sideways range of the pelvis in median trunk lengths."""
    trunk = quantiles(df.select(*keys, g.distance("thorax", "pelvis").alias("_t")), keys, "_t", {"_trunk": 0.5})
    spread = df.groupBy(*keys).agg((F.max(F.col("pelvis")["x"]) - F.min(F.col("pelvis")["x"])).alias("_r"))
    return join_same(spread, trunk, keys).select(*keys, F.when(F.col("_trunk") >= 1e-9, F.col("_r") / F.col("_trunk")).alias("excursion"))


def anterior_offset(df: DataFrame, keys: list[str], side: str) -> DataFrame:
    """Ankle ahead of the pelvis along x, in median trunk lengths."""
    trunk = quantiles(df.select(*keys, g.distance("thorax", "pelvis").alias("_t")), keys, "_t", {"_trunk": 0.5})
    scale = F.when(F.col("_trunk") > 1e-9, F.col("_trunk")).otherwise(1.0)
    return join_same(df, trunk, keys).select(*keys, "frame", ((F.col(f"{side}_ankle")["x"] - F.col("pelvis")["x"]) / scale).alias("offset"))


def align(df: DataFrame, fitted: list[str], prefix: str, target: str, scale: bool = False) -> DataFrame:
    """Rotate, shift and, with ``scale``, resize the whole skeleton onto another, fitted on a few joints per frame.

    ``prefix`` + joint are the moving points and ``target`` + joint the fixed ones. A fitted
    joint with an undefined coordinate on either side is skipped; with fewer than three left
    the frame stays as it is. Adds ``<prefix><joint>_aligned`` for every joint the frame has;
    it is NULL where the joint is, and in all joints where the size of moving points that
    coincide would have to be changed.
    """
    axes = [f"{side}{a}" for side in "sd" for a in "xyz"]
    seen = F.array(*[F.struct(*[F.nanvl(c.cast("double"), F.lit(None)).alias(n) for n, c in zip(
        axes, [*vec(f"{prefix}{j}"), *vec(f"{target}{j}")])]) for j in fitted])
    df = df.withColumn("_pairs", F.filter(seen, lambda p: reduce(and_, [p[a].isNotNull() for a in axes])))

    def added(total: Column, more: Column) -> Column:
        return F.zip_with(total, more, lambda x, y: x + y)

    def zeros(n: int) -> Column:
        return F.array(*[F.lit(0.0)] * n)
    sums = F.aggregate("_pairs", zeros(6), lambda t, p: added(t, F.array(*[p[a] for a in axes])))
    df = df.withColumn("_centre", F.transform(sums, lambda v: ratio(v, F.size("_pairs"))))

    def products(p: Column) -> Column:
        s, d = ([p[axes[i + k]] - F.col("_centre")[i + k] for k in range(3)] for i in (0, 3))
        return F.array(*[x * y for x in s for y in d], s[0] * s[0] + s[1] * s[1] + s[2] * s[2])
    df = df.withColumn("_sums", F.aggregate("_pairs", zeros(10), lambda t, p: added(t, products(p))))
    df = df.withColumn("_fit", rotation_and_fit(F.slice("_sums", 1, 9)))
    size = ratio(F.col("_fit")["fit"], F.col("_sums")[9]) if scale else F.lit(1.0)
    df = df.withColumn("_size", size)
    rows = [tuple(F.col("_fit")["rotation"][3 * i + k] for k in range(3)) for i in range(3)]
    middle = [tuple(F.col("_centre")[i + k] for k in range(3)) for i in (0, 3)]
    enough = F.size("_pairs") >= 3
    joints = [c[len(prefix):] for c in df.columns if c.startswith(prefix) and c[len(prefix):] in g.JOINTS]
    moved = {}
    for j in joints:
        own = vec(f"{prefix}{j}")
        turned = [dot(row, sub(own, middle[0])) * F.col("_size") + middle[1][i] for i, row in enumerate(rows)]
        moved[f"{prefix}{j}_aligned"] = point(tuple(F.when(enough, new).otherwise(old) for new, old in zip(turned, own)))
    return df.withColumns(moved).drop("_pairs", "_centre", "_sums", "_fit", "_size")


def pelvis_frame_2d(df: DataFrame) -> DataFrame:
    """Add the image-plane hip axis, its perpendicular and the torso length."""
    dx, dy = F.col("r_hip")["x"] - F.col("l_hip")["x"], F.col("r_hip")["y"] - F.col("l_hip")["y"]
    df = df.withColumns({"_ax": dx, "_ay": dy}).withColumn("_an", F.greatest(F.hypot("_ax", "_ay"), F.lit(1e-9)))
    torso = g.distance_2d(g.middle("l_shoulder", "r_shoulder"), g.middle("l_hip", "r_hip"))
    return df.withColumns({"_ax": F.col("_ax") / F.col("_an"), "_ay": F.col("_ay") / F.col("_an"), "_torso": torso}).drop("_an")


def measure_offset(df: DataFrame, detected: str) -> DataFrame:
    """Mean and SD of a detected hip's displacement in the pelvis frame, in torso lengths."""
    df = pelvis_frame_2d(df).filter(F.col("_torso") > 1e-6)
    hips = F.array(*[F.struct(F.lit(h).alias("hip"), (F.col(f"{detected}{h}")["x"] - F.col(h)["x"]).alias("ox"),
                              (F.col(f"{detected}{h}")["y"] - F.col(h)["y"]).alias("oy")) for h in ("l_hip", "r_hip")])
    long = df.select("_ax", "_ay", "_torso", F.inline(hips))
    along = (F.col("ox") * F.col("_ax") + F.col("oy") * F.col("_ay")) / F.col("_torso")
    perp = (F.col("oy") * F.col("_ax") - F.col("ox") * F.col("_ay")) / F.col("_torso")
    return long.groupBy("hip").agg(
        F.count(F.lit(1)).alias("n"), F.avg(along).alias("along_mean"), F.stddev_samp(along).alias("along_sd"),
        F.avg(perp).alias("perp_mean"), F.stddev_samp(perp).alias("perp_sd"))


def apply_offset(df: DataFrame, offsets: DataFrame) -> DataFrame:
    """Displace both hips by the measured offset in each frame's own units."""
    df = pelvis_frame_2d(df)

    def cell(hip: str, name: str) -> Column:
        return offsets.filter(F.col("hip") == hip).select(name).scalar()
    out = {}
    for h in ("l_hip", "r_hip"):
        a, p = cell(h, "along_mean") * F.col("_torso"), cell(h, "perp_mean") * F.col("_torso")
        out[f"{h}_moved"] = F.struct((F.col(h)["x"] + a * F.col("_ax") - p * F.col("_ay")).alias("x"),
                                     (F.col(h)["y"] + a * F.col("_ay") + p * F.col("_ax")).alias("y"))
    return df.withColumns(out).drop("_ax", "_ay", "_torso")


def frame_quality(df: DataFrame, keys: list[str], score: str) -> DataFrame:
    """Per limb segment and frame: length deviation, left-right asymmetry, motion, far flag.

    ``score`` is an array column of joint scores in joint order.
    """
    limbs = ["thigh_l", "thigh_r", "shank_l", "shank_r"]
    lower = ["l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle"]
    medians = body_model(lengths(df.select(*keys, "frame", *g.JOINTS)), keys).filter(F.col("segment").isin(limbs))
    near = near_limb(df, keys)
    thin = df.select(*keys, "frame", score, *lower, g.distance_2d(g.middle("l_shoulder", "r_shoulder"), vec("pelvis")).alias("_trunk"))
    halo = with_halo(thin, "frame", 1)
    w = block_window(keys, "frame")
    gone = [g.distance_2d(vec(j), (F.lag(F.col(j)["x"], 1).over(w), F.lag(F.col(j)["y"], 1).over(w), None)) for j in lower]
    moved = halo.withColumn("_d", sum(gone[1:], gone[0]) / len(lower)).withColumn("_speed", F.col("_d") / F.greatest(F.col("_trunk"), F.lit(1e-9)))
    moved = moved.withColumn("speed", F.coalesce("_speed", F.lead("_speed", 1).over(w), F.lit(0.0))).filter(~F.col("_halo"))
    place = {j: i for i, j in enumerate(g.JOINTS)}
    entries = []
    for n in limbs:
        a, b = g.SEGMENTS[n]
        pa, pb = g.SEGMENTS[n[:-1] + ("r" if n[-1] == "l" else "l")]
        own, other = g.distance(a, b), g.distance(pa, pb)
        entries.append(F.struct(
            F.lit(n).alias("segment"), F.lit(n[-1]).alias("_side"), own.alias("_len"),
            F.least(F.col(score)[place[a]], F.col(score)[place[b]]).alias("score_min"),
            (F.abs(own - other) / F.greatest((own + other) / 2.0, F.lit(1e-9))).alias("lr_asym")))
    long = moved.select(*keys, "frame", "speed", F.inline(F.array(*entries)))
    dev = F.abs(F.col("_len") - F.col("length")) / F.greatest(F.col("length"), F.lit(1e-9))
    return (join_same(join_same(long, medians, [*keys, "segment"]), near, keys)
            .withColumn("len_dev", dev).withColumn("is_far", (F.col("_side") != F.col("near")).cast("int"))
            .select(*keys, "frame", "segment", "score_min", "len_dev", "lr_asym", "speed", "is_far"))


def blend(df: DataFrame, joint: str, other: str, alpha: float) -> DataFrame:
    """Point between two tables' copies of a joint, with the pixel error to the second."""
    a, b = vec(joint), vec(other)
    mixed = g.add(g.times(a, 1.0 - alpha), g.times(b, alpha))
    return stage(df, blended=mixed).withColumn("pixel_error", g.distance_2d(vec("blended"), b))


def root_relative_error(df: DataFrame, estimate: str, unit_factor: str) -> DataFrame:
    """Mean joint distance after putting both roots at the origin; targets divided by the factor."""
    terms = []
    for j in g.JOINTS:
        est = sub(vec(f"{estimate}{j}"), vec(f"{estimate}pelvis"))
        ref = g.times(sub(vec(j), vec("pelvis")), 1.0 / F.col(unit_factor))
        terms.append(g.norm(sub(est, ref)))
    return df.withColumn("mean_error", sum(terms[1:], terms[0]) / len(terms))


def normalise_scale(df: DataFrame, keys: list[str], joints: list[str]) -> DataFrame:
    """Root-relative x and y divided by the clip's largest absolute coordinate."""
    rel = {j: F.struct((F.col(j)["x"] - F.col("pelvis")["x"]).alias("x"), (F.col(j)["y"] - F.col("pelvis")["y"]).alias("y")) for j in joints}
    moved = df.withColumns(rel)
    largest = F.greatest(*[F.abs(F.col(j)[a]) for j in joints for a in "xy"])
    scale = moved.groupBy(*keys).agg(F.max(largest).alias("scale"))
    out = join_same(moved, scale, keys)
    return out.withColumns({j: F.struct(*[ratio(F.col(j)[a], F.col("scale")).alias(a) for a in "xy"]) for j in joints})


def normalise_image(df: DataFrame, joints: list[str], width: Column, height: Column) -> DataFrame:
    """x and y by the image's width: x from -1 to 1, y from -height/width to height/width; NULL without a size."""
    wide = F.nullif(width.cast("double"), F.lit(0.0))
    return df.withColumns({j: F.struct((F.col(j)["x"] / wide * 2 - 1).alias("x"), (F.col(j)["y"] / wide * 2 - height / wide).alias("y"))
                           for j in joints})


def nearest_slots(df: DataFrame, targets: list[str], slots: list[str], slot_prefix: str) -> DataFrame:
    """For each target point, the slot with the smallest median image distance.

    Targets times slots is a fixed small number per frame, whatever the number of frames.
    """
    pairs = F.array(*[F.struct(F.lit(t).alias("target"), F.lit(s).alias("slot"), F.lit(i).alias("_o"),
                               g.distance_2d(vec(t), vec(f"{slot_prefix}{s}")).alias("_d"))
                      for t in targets for i, s in enumerate(slots)])
    long = df.select(F.inline(pairs))
    mid = quantiles(long, ["target", "slot", "_o"], "_d", {"median": 0.5})
    best = F.min(F.struct(F.round("median", 9).alias("m"), F.col("_o").alias("o"), F.col("slot").alias("s"), F.col("median").alias("d")))
    return mid.groupBy("target").agg(best.alias("_b")).select(
        "target", F.col("_b")["s"].alias("slot"), F.col("_b")["d"].alias("distance"), (F.col("_b")["s"] != F.col("target")).alias("mismatch"))
