"""Geometry queries: the first 51 numbers of an embedding are 17 joints, its label the clip."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograin.functions import geometry as g
from tempograin.functions.numeric import r6, wrap_degrees
from tempograin.operators import geometry as ops
from tempograin.operators.joins import grid
from tempograin.operators.ordered import quantiles
from tempograin.operators.series import number_frames
from tempograin.plans.registry import query
from tempograin.sources.tables import Tables

J = g.JOINTS
CLIP = ["clip"]


def _joint(i: int, name: str, prefix: str = ""):
    e = F.col("embedding")
    return F.struct(*[(e[3 * i + k].cast("double") * 100).alias(a) for k, a in enumerate("xyz")]).alias(prefix + name)


def skeletons(t: Tables) -> DataFrame:
    """(vec_id, clip, one struct per joint) for every embedding."""
    return t.embeddings.select("vec_id", F.col("label").alias("clip"), *[_joint(i, n) for i, n in enumerate(J)])


def clip_skeletons(t: Tables) -> DataFrame:
    """The same with a dense frame number inside each clip."""
    return number_frames(skeletons(t), CLIP, ["vec_id"])


def paired_skeletons(t: Tables, prefix: str = "est_") -> DataFrame:
    """Each frame beside another's skeleton, its estimate: the next embedding's."""
    other = t.embeddings.select((F.col("vec_id") - 1).alias("vec_id"), *[_joint(i, n, prefix) for i, n in enumerate(J)])
    return skeletons(t).join(other, "vec_id")


# ------------------------------------------------------------------- the SQL counterpart

SKEL = "skel AS (SELECT vec_id, label AS clip, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame, " + ", ".join(
    f"embedding[{3 * i + k + 1}]::DOUBLE * 100 AS {n}_{a}" for i, n in enumerate(J) for k, a in enumerate("xyz")) + " FROM embeddings)"


def sv(name):
    return tuple(f"{name}_{a}" for a in "xyz")


def sc(x, y, z):
    return (f"{x}::DOUBLE", f"{y}::DOUBLE", f"{z}::DOUBLE")


def ssub(a, b):
    return tuple(f"({p} - {q})" for p, q in zip(a, b))


def sadd(a, b):
    return tuple(f"({p} + {q})" for p, q in zip(a, b))


def smul(a, k):
    return tuple(f"({p} * {k})" for p in a)


def sdot(a, b):
    return "(" + " + ".join(f"{p} * {q}" for p, q in zip(a, b)) + ")"


def scross(a, b):
    return (f"({a[1]} * {b[2]} - {a[2]} * {b[1]})", f"({a[2]} * {b[0]} - {a[0]} * {b[2]})", f"({a[0]} * {b[1]} - {a[1]} * {b[0]})")


def snorm(a):
    return f"sqrt({sdot(a, a)})"


def smid(*names):
    total = sv(names[0])
    for n in names[1:]:
        total = sadd(total, sv(n))
    return smul(total, repr(1.0 / len(names)) + "::DOUBLE")


def sdist(a, b):
    return snorm(ssub(sv(a), sv(b)))


def sdist2(a, b):
    return f"sqrt(({a[0]} - {b[0]}) * ({a[0]} - {b[0]}) + ({a[1]} - {b[1]}) * ({a[1]} - {b[1]}))"


def cols(name, v):
    return ", ".join(f"{e} AS {name}_{a}" for e, a in zip(v, "xyz"))


def unit_stage(src, dst, name, v):
    """Two CTEs adding the unit vector of ``v`` as ``name`` to ``src``."""
    raw = f"{name}_raw"
    return (f"{dst}_0 AS (SELECT *, {cols(raw, v)} FROM {src}), "
            f"{dst} AS (SELECT *, {cols(name, tuple(f'({c} / greatest({snorm(sv(raw))}, 1e-9))' for c in sv(raw)))} FROM {dst}_0)")


def sangle(v, f, u):
    return f"degrees(atan2({sdot(v, f)}, {sdot(v, u)}))"


def swrap(e):
    return f"((((({e}) + 180.0::DOUBLE) % 360.0::DOUBLE) + 360.0::DOUBLE) % 360.0::DOUBLE - 180.0::DOUBLE)"


def body_sql(src, out):
    return ", ".join([
        unit_stage(src, f"{out}_a", "u0", ssub(sv("thorax"), sv("pelvis"))),
        unit_stage(f"{out}_a", f"{out}_b", "ml", ssub(sv("r_hip"), sv("l_hip"))),
        unit_stage(f"{out}_b", f"{out}_c", "fwd", scross(sv("ml"), sv("u0"))),
        unit_stage(f"{out}_c", out, "up", scross(sv("fwd"), sv("ml")))])


def sagittal_sql(src, out, up, f="fwd", u="up"):
    return ", ".join([
        unit_stage(src, f"{out}_a", f"{out}ml", ssub(sv("r_hip"), sv("l_hip"))),
        unit_stage(f"{out}_a", f"{out}_b", f"{out}u", up),
        unit_stage(f"{out}_b", f"{out}_c", f, scross(sv(f"{out}u"), sv(f"{out}ml"))),
        unit_stage(f"{out}_c", out, u, scross(sv(f"{out}ml"), sv(f)))])


def r(e, n=6):
    return f"round({e}, {n}) + 0.0"


_T = {s: sangle(ssub(sv(f"{s}_knee"), sv(f"{s}_hip")), sv("fwd"), sv("up")) for s in "lr"}
_S = {s: sangle(ssub(sv(f"{s}_ankle"), sv(f"{s}_knee")), sv("fwd"), sv("up")) for s in "lr"}


@query("g01_body_frame_angles", f"WITH {SKEL}, {body_sql('skel', 'b')} SELECT vec_id, " + ", ".join(
    f"{r(swrap(_T[s] + ' - 180'))} AS hip_{s}, {r(swrap(_S[s] + ' - ' + _T[s]))} AS knee_{s}, NULL::DOUBLE AS ankle_{s}" for s in "lr") + " FROM b")
def _(t):
    out = ops.sagittal_angles(skeletons(t))
    return out.select("vec_id", *[r6(F.col(f"{q}_{s}")).alias(f"{q}_{s}") for s in "lr" for q in ("hip", "knee", "ankle")])


UP = (0, -1, 0)
_INC = {f"{q}_{s}": sangle(ssub(sv(f"{s}_{b}"), sv(f"{s}_{a}")), sv("fwd"), smul(sv("up"), "-1"))
        for s in "lr" for q, a, b in (("thigh", "hip", "knee"), ("shank", "knee", "ankle"))}


@query("g02_segment_inclinations", f"WITH {SKEL}, {sagittal_sql('skel', 'b', sc(*UP))} SELECT vec_id, " + ", ".join(
    f"{r(e)} AS {n}" for n, e in _INC.items()) + f", {r(sangle(ssub(sv('thorax'), sv('pelvis')), sv('fwd'), sv('up')))} AS trunk, " + ", ".join(
    f"{r(swrap(_INC[f'shank_{s}'] + ' - ' + _INC[f'thigh_{s}']))} AS knee_from_segments_{s}" for s in "lr") + " FROM b")
def _(t):
    out = ops.segment_angles(skeletons(t), g.const(*UP))
    names = [*_INC, "trunk", "knee_from_segments_l", "knee_from_segments_r"]
    return out.select("vec_id", *[r6(F.col(c)).alias(c) for c in names])


LIMBS = {k: v for k, v in g.SEGMENTS.items() if k.startswith(("thigh", "shank"))}
_DIR = {n: sangle(ssub(sv(b), sv(a)), sv("fwd"), sv("up")) for n, (a, b) in LIMBS.items()}


@query("g03_direction_error", f"WITH {SKEL}, {body_sql('skel', 'b')}, dirs AS (SELECT vec_id, " + ", ".join(
    f"{e} AS {n}" for n, e in _DIR.items()) + " FROM b) SELECT a.vec_id, " + ", ".join(
    f"{r('abs(' + swrap(f'e.{n} - a.{n}') + ')')} AS {n}" for n in LIMBS) + " FROM dirs a JOIN dirs e ON e.vec_id = a.vec_id + 1")
def _(t):
    truth = ops.segment_directions(skeletons(t), LIMBS).select("vec_id", *LIMBS)
    est = truth.select((F.col("vec_id") - 1).alias("vec_id"), *[F.col(n).alias(f"est_{n}") for n in LIMBS])
    return truth.join(est, "vec_id").select("vec_id", *[
        r6(F.abs(wrap_degrees(F.col(f"est_{n}") - F.col(n)))).alias(n) for n in LIMBS])


@query("g04_view_ratio", f"WITH {SKEL} SELECT clip, {r(f'avg(abs(l_hip_z - r_hip_z) / greatest({sdist("l_hip", "r_hip")}, 1e-9))')} AS view_ratio FROM skel GROUP BY 1")
def _(t):
    return ops.view_ratio(skeletons(t), CLIP).withColumn("view_ratio", r6(F.col("view_ratio")))


_RATIO = f"({sdist2(sv('l_hip'), sv('r_hip'))} / greatest({sdist2(smid('l_shoulder', 'r_shoulder'), smid('l_hip', 'r_hip'))}, 1e-9))"


@query("g05_azimuth_proxy", f"WITH {SKEL} SELECT vec_id, {r(_RATIO)} AS ratio, {r(f'degrees(acos(greatest(0.0::DOUBLE, least(1.0::DOUBLE, {_RATIO} / 0.4663::DOUBLE))))', 5)} AS azimuth FROM skel")
def _(t):
    ratio = ops.apparent_ratio()
    return skeletons(t).select("vec_id", r6(ratio).alias("ratio"), (F.round(g.azimuth(ratio), 5) + 0.0).alias("azimuth"))


@query("g06_estimated_view_ratio", f"""WITH {SKEL},
v AS (SELECT clip, sqrt(greatest(0.0::DOUBLE, 1 - power(least(1.0::DOUBLE, {_RATIO} / 0.4663::DOUBLE), 2))) AS v FROM skel)
SELECT clip, count(v) AS n, CASE WHEN count(v) >= 5 THEN {r('quantile_cont(v, 0.5)')} END AS view_ratio FROM v GROUP BY 1""")
def _(t):
    return ops.estimated_view(skeletons(t), CLIP).withColumn("view_ratio", r6(F.col("view_ratio")))


# Fixed values of two example cameras.
CAMERAS = {
    "cam_a": {"R": g.rotation_about("x", 80.0), "t": [5.0, -10.0, 900.0], "fx": 980.0, "fy": 975.0, "cx": 400.0, "cy": 300.0, "k1": -0.11, "k2": 0.02},
    "cam_b": {"R": g.rotation_about("y", 35.0), "t": [-15.0, 4.0, 700.0], "fx": 990.0, "fy": 985.0, "cx": 410.0, "cy": 295.0, "k1": -0.09, "k2": 0.01}}


def _camera_sql() -> str:
    rows = []
    for n, c in CAMERAS.items():
        cam = [f"({c['R'][i][0]!r}::DOUBLE * r_knee_x + {c['R'][i][1]!r}::DOUBLE * r_knee_y + {c['R'][i][2]!r}::DOUBLE * r_knee_z + {c['t'][i]!r}::DOUBLE)" for i in range(3)]
        rows.append(f"SELECT vec_id, '{n}' AS camera, {cam[0]} AS cam_x, {cam[1]} AS cam_y, {cam[2]} AS cam_z, {c['fx']} AS fx, {c['fy']} AS fy, {c['cx']} AS cx, {c['cy']} AS cy, {c['k1']} AS k1, {c['k2']} AS k2 FROM skel")
    return "cam AS (" + " UNION ALL ".join(rows) + ")"


@query("g07_projection", f"""WITH {SKEL}, {_camera_sql()},
p AS (SELECT *, power(cam_x / cam_z, 2) + power(cam_y / cam_z, 2) AS r2 FROM cam)
SELECT vec_id, camera, {r('cam_z')} AS depth, {r('cam_x / cam_z * (1 + k1 * r2 + k2 * r2 * r2) * fx + cx', 5)} AS px, {r('cam_y / cam_z * (1 + k1 * r2 + k2 * r2 * r2) * fy + cy', 5)} AS py FROM p""")
def _(t):
    out = ops.project(skeletons(t), "r_knee", CAMERAS)
    return out.select("vec_id", "camera", r6(F.col("cam_z")).alias("depth"), *[(F.round(c, 5) + 0.0).alias(c) for c in ("px", "py")])


@query("g08_near_limb", f"WITH {SKEL} SELECT clip, CASE WHEN avg(l_hip_z) < avg(r_hip_z) THEN 'l' ELSE 'r' END AS near FROM skel GROUP BY 1")
def _(t):
    return ops.near_limb(skeletons(t), CLIP)


@query("g09_camera_tilt", f"""WITH {SKEL}, {unit_stage('skel', 'cx', 'ax', sv('r_hip'))}, {unit_stage('cx', 'cz', 'az', scross(sv('ax'), sv('thorax')))},
cy AS (SELECT *, {cols('ay', scross(sv('az'), sv('ax')))} FROM cz)
SELECT vec_id, {r('degrees(asin(greatest(-1, least(1, az_z))))', 5)} AS pitch, {r('degrees(asin(greatest(-1, least(1, ax_z))))', 5)} AS roll,
  {r('degrees(acos(greatest(-1, least(1, -ay_z / greatest(' + snorm(sv('ay')) + ', 1e-12)))))', 5)} AS tilt FROM cy""")
def _(t):
    """Each frame's joints double as a camera: axes from two of its points, world up is z."""
    df = ops.stage(skeletons(t), _x=g.unit(g.vec("r_hip")))
    df = ops.stage(df, _z0=g.cross(g.vec("_x"), g.vec("thorax")))
    df = ops.stage(df, _z=g.unit(g.vec("_z0")))
    df = ops.stage(df, _y=g.cross(g.vec("_z"), g.vec("_x")))
    tilt = ops.camera_tilt([g.vec("_x"), g.vec("_y"), g.vec("_z")], g.const(0, 0, 1))
    return df.select("vec_id", *[(F.round(c, 5) + 0.0).alias(n) for n, c in tilt.items()])


@query("g09_level_error", f"WITH {SKEL}, {sagittal_sql('skel', 'tb', sc(0, 0, 1), 'tf', 'tu')}, {sagittal_sql('tb', 'ab', sc(0.1, 0, 0.9), 'af', 'au')} SELECT vec_id, {r(sangle(sv('au'), sv('tf'), sv('tu')))} AS level_error FROM ab")
def _(t):
    out = ops.level_error(skeletons(t), g.const(0, 0, 1), g.const(0.1, 0, 0.9))
    return out.select("vec_id", r6(F.col("level_error")).alias("level_error"))


@query("g10_signed_plane_angle", f"""WITH {SKEL}, {body_sql('skel', 'b')}
SELECT vec_id, {r(swrap(sangle(ssub(sv('head'), sv('neck')), sv('fwd'), sv('up')) + ' - ' + sangle(ssub(sv('neck'), sv('thorax')), sv('fwd'), sv('up'))))} AS angle FROM b""")
def _(t):
    out = ops.segment_directions(skeletons(t), {"a": ("neck", "head"), "b": ("thorax", "neck")})
    return out.select("vec_id", r6(wrap_degrees(F.col("a") - F.col("b"))).alias("angle"))


_MEANS = ", ".join(f"avg({j}_{a}) AS m_{j}_{a}" for j in ("pelvis", "l_ankle", "r_ankle", "l_hip", "r_hip") for a in "xyz")
FRAME = f"""means AS (SELECT clip, {_MEANS} FROM skel GROUP BY 1),
{unit_stage('means', 'f1', 'up', ssub(sv('m_pelvis'), smid('m_l_ankle', 'm_r_ankle')))},
f2 AS (SELECT *, {cols('ac', ssub(sv('m_r_hip'), sv('m_l_hip')))} FROM f1),
{unit_stage('f2', 'f3', 'rt', ssub(sv('ac'), smul(sv('up'), sdot(sv('ac'), sv('up')))))},
f4 AS (SELECT *, {cols('po', scross(sv('rt'), sv('up')))} FROM f3)"""


@query("g11_anatomical_frame", f"WITH {SKEL}, {FRAME} SELECT clip, " + ", ".join(
    f"{r(f'{c}_{a}')} AS {n}_{a}" for c, n in (("rt", "right"), ("up", "up"), ("po", "posterior")) for a in "xyz") + " FROM f4")
def _(t):
    out = ops.anatomical_frame(skeletons(t), CLIP)
    return out.select("clip", *[r6(F.col(n)[a]).alias(f"{n}_{a}") for n in ("right", "up", "posterior") for a in "xyz"])


@query("g11_frame_checks", f"""WITH {SKEL}, {FRAME},
j AS (SELECT s.*, {', '.join(f'{c}_{a}' for c in ('rt', 'up', 'po') for a in 'xyz')} FROM skel s JOIN f4 USING (clip)),
a AS (SELECT clip, avg({sdot(ssub(sv('pelvis'), sv('r_ankle')), sv('up'))}) AS h, avg({sdot(ssub(sv('spine'), sv('thorax')), sv('po'))}) AS b,
  avg({sdot(ssub(sv('r_hip'), sv('l_hip')), sv('rt'))}) AS sp, avg({sdot(scross(sv('rt'), sv('up')), sv('po'))}) AS hd FROM j GROUP BY 1)
SELECT clip, {r('h')} AS height, {r('b')} AS behind, concat_ws('; ', CASE WHEN NOT h > 1 THEN 'pelvis above ankle' END,
  CASE WHEN NOT b > 0.5 THEN 'spine behind thorax' END, CASE WHEN NOT sp > 0 THEN 'right hip on the right' END, CASE WHEN NOT abs(hd - 1) < 1e-6 THEN 'right-handed' END) AS failures FROM a""")
def _(t):
    s = skeletons(t)
    out = ops.check_frames(s, ops.anatomical_frame(s, CLIP), CLIP, (1.0, 0.5))
    return out.select("clip", r6(F.col("height")).alias("height"), r6(F.col("behind")).alias("behind"), F.concat_ws("; ", "failures").alias("failures"))


@query("g12_trunk_lean", f"""WITH {SKEL},
m AS (SELECT clip, frame, lead(pelvis_x, 10) OVER w - pelvis_x AS vx, lead(pelvis_y, 10) OVER w - pelvis_y AS vy,
  lead(thorax_x - pelvis_x, 5) OVER w AS tx, lead(thorax_y - pelvis_y, 5) OVER w AS ty, lead(thorax_z - pelvis_z, 5) OVER w AS tz FROM skel WINDOW w AS (PARTITION BY clip ORDER BY frame)),
a AS (SELECT clip, degrees(atan2((tx * vx + ty * vy) / sqrt(vx * vx + vy * vy), tz)) AS ang FROM m WHERE sqrt(vx * vx + vy * vy) > 1e-3)
SELECT clip, count(*) AS n, CASE WHEN count(*) >= 5 THEN {r('avg(ang)')} END AS lean, CASE WHEN count(*) >= 5 THEN {r('stddev_samp(ang)')} END AS lean_sd FROM a GROUP BY 1""")
def _(t):
    out = ops.trunk_lean(clip_skeletons(t), CLIP)
    return out.select("clip", "n", r6(F.col("lean")).alias("lean"), r6(F.col("lean_sd")).alias("lean_sd"))


_UPZ = sc(0, 0, 1)


@query("g12_tilt_and_trunk", f"""WITH {SKEL}, {unit_stage('skel', 'a', 'ml', ssub(sv('r_hip'), sv('l_hip')))}, {unit_stage('a', 'b', 'f', scross(sv('ml'), _UPZ))}
SELECT vec_id, {r(f"degrees(atan2({sdot(ssub(sv('pelvis'), sv('spine')), _UPZ)}, {sdot(ssub(sv('pelvis'), sv('spine')), sv('f'))}))")} AS tilt,
  {r(sangle(ssub(sv('thorax'), sv('pelvis')), sv('f'), _UPZ))} AS trunk FROM b""")
def _(t):
    out = ops.upright_angles(skeletons(t))
    return out.select("vec_id", r6(F.col("tilt")).alias("tilt"), r6(F.col("trunk")).alias("trunk"))


FITTED = ["pelvis", "l_hip", "r_hip", "l_knee", "r_knee"]


def _alignment_sql() -> str:
    """Least possible RMS after a rotation, from the singular values of the covariance."""
    n = len(FITTED)
    mean = {p: {a: "(" + " + ".join(f"{p}.{j}_{a}" for j in FITTED) + f") / {n}" for a in "xyz"} for p in "se"}
    pts = "pt AS (SELECT s.vec_id, " + ", ".join(
        f"{p}.{j}_{a} - {mean[p][a]} AS {p}_{j}_{a}" for p in "se" for j in FITTED for a in "xyz") + " FROM skel s JOIN skel e ON e.vec_id = s.vec_id + 1)"
    cov = ", ".join("(" + " + ".join(f"s_{j}_{a} * e_{j}_{b}" for j in FITTED) + f") / {n} AS h{i}{k}" for i, a in enumerate("xyz") for k, b in enumerate("xyz"))
    size = "(" + " + ".join(f"{p}_{j}_{a} * {p}_{j}_{a}" for p in "se" for j in FITTED for a in "xyz") + f") / {n} AS size"
    m = ", ".join("(" + " + ".join(f"h{r}{i} * h{r}{k}" for r in range(3)) + f") AS m{i}{k}" for i in range(3) for k in range(i, 3))
    det = "h00 * (h11 * h22 - h12 * h21) - h01 * (h10 * h22 - h12 * h20) + h02 * (h10 * h21 - h11 * h20)"
    return f"""{pts},
hc AS (SELECT vec_id, {cov}, {size} FROM pt),
mm AS (SELECT vec_id, size, {m}, sign({det}) AS sg FROM hc),
q1 AS (SELECT *, (m00 + m11 + m22) / 3 AS q FROM mm),
q2 AS (SELECT *, sqrt((power(m00 - q, 2) + power(m11 - q, 2) + power(m22 - q, 2) + 2 * (m01 * m01 + m02 * m02 + m12 * m12)) / 6) AS p FROM q1),
q3 AS (SELECT *, acos(greatest(-1, least(1, ((m00 - q) * ((m11 - q) * (m22 - q) - m12 * m12) - m01 * (m01 * (m22 - q) - m12 * m02) + m02 * (m01 * m12 - (m11 - q) * m02)) / (2 * p * p * p)))) / 3 AS f FROM q2),
q4 AS (SELECT *, q + 2 * p * cos(f) AS e1, q + 2 * p * cos(f + 2 * pi() / 3) AS e3 FROM q3)
SELECT vec_id, round(sqrt(greatest(0, size - 2 * (sqrt(greatest(0, e1)) + sqrt(greatest(0, 3 * q - e1 - e3)) + sg * sqrt(greatest(0, e3))))), 4) + 0.0 AS rms FROM q4"""


@query("g13_rigid_alignment", f"WITH {SKEL}, {_alignment_sql()}")
def _(t):
    """RMS distance of the fitted joints after the best rotation and shift per frame."""
    out = ops.align(paired_skeletons(t), FITTED, "est_", "")
    gaps = [g.sub(g.vec(f"est_{j}_aligned"), g.vec(j)) for j in FITTED]
    squares = [g.dot(v, v) for v in gaps]
    return out.select("vec_id", (F.round(F.sqrt(sum(squares[1:], squares[0]) / len(FITTED)), 4) + 0.0).alias("rms"))


@query("g14_camera_azimuth", f"""WITH {SKEL}, c AS (SELECT clip, avg(head_x) AS cx, avg(head_y) AS cy FROM skel GROUP BY 1)
SELECT vec_id, {r('degrees(atan2(head_y - cy, head_x - cx))')} AS azimuth FROM skel JOIN c USING (clip)""")
def _(t):
    s = skeletons(t)
    centre = s.groupBy("clip").agg(F.avg(F.col("head")["x"]).alias("_cx"), F.avg(F.col("head")["y"]).alias("_cy"))
    return s.join(centre, "clip").select(
        "vec_id", r6(F.degrees(F.atan2(F.col("head")["y"] - F.col("_cy"), F.col("head")["x"] - F.col("_cx")))).alias("azimuth"))


_LOWER = ["l_hip", "r_hip", "l_knee", "r_knee", "l_ankle", "r_ankle"]
_MOVE = " + ".join(f"sqrt(power({j}_x - lag({j}_x) OVER w, 2) + power({j}_y - lag({j}_y) OVER w, 2))" for j in _LOWER)
LENGTHS = "len AS (" + " UNION ALL ".join(f"SELECT clip, vec_id, frame, '{n}' AS segment, {sdist(a, b)} AS length FROM skel" for n, (a, b) in g.SEGMENTS.items()) + ")"


def _quality_sql() -> str:
    parts = []
    place = {j: i for i, j in enumerate(J)}
    for n in LIMBS:
        a, b = g.SEGMENTS[n]
        pa, pb = g.SEGMENTS[n[:-1] + ("r" if n[-1] == "l" else "l")]
        own, oth = sdist(a, b), sdist(pa, pb)
        parts.append(f"SELECT clip, frame, vec_id, '{n}' AS segment, '{n[-1]}' AS side, {own} AS ln, "
                     f"least(score[{place[a] + 1}], score[{place[b] + 1}]) AS score_min, abs({own} - {oth}) / greatest(({own} + {oth}) / 2, 1e-9) AS lr_asym FROM skel JOIN sco USING (vec_id)")
    return " UNION ALL ".join(parts)


@query("g15_frame_quality", f"""WITH {SKEL}, {LENGTHS},
sco AS (SELECT vec_id, list_transform(generate_series(48, 64), lambda i: abs(embedding[i]::DOUBLE)) AS score FROM embeddings),
med AS (SELECT clip, segment, quantile_cont(length, 0.5) AS m FROM len GROUP BY 1, 2),
nl AS (SELECT clip, CASE WHEN avg(l_hip_z) < avg(r_hip_z) THEN 'l' ELSE 'r' END AS near FROM skel GROUP BY 1),
sp0 AS (SELECT clip, frame, ({_MOVE}) / 6 / greatest({sdist2(smid('l_shoulder', 'r_shoulder'), sv('pelvis'))}, 1e-9) AS s FROM skel WINDOW w AS (PARTITION BY clip ORDER BY frame)),
sp AS (SELECT clip, frame, coalesce(s, lead(s) OVER (PARTITION BY clip ORDER BY frame), 0) AS speed FROM sp0),
q AS ({_quality_sql()})
SELECT q.clip, q.frame, q.segment, {r('score_min')} AS score_min, {r('abs(ln - m) / greatest(m, 1e-9)')} AS len_dev, {r('lr_asym')} AS lr_asym, {r('speed')} AS speed,
  CAST(CASE WHEN side <> near THEN 1 ELSE 0 END AS INTEGER) AS is_far
FROM q JOIN med ON med.clip = q.clip AND med.segment = q.segment JOIN nl ON nl.clip = q.clip JOIN sp ON sp.clip = q.clip AND sp.frame = q.frame""")
def _(t):
    scores = F.transform(F.slice("embedding", 48, 17), lambda v: F.abs(v.cast("double")))
    s = t.embeddings.select("vec_id", F.col("label").alias("clip"), scores.alias("score"), *[_joint(i, n) for i, n in enumerate(J)])
    out = ops.frame_quality(number_frames(s, CLIP, ["vec_id"]), CLIP, "score")
    return out.select("clip", "frame", "segment", "is_far", *[r6(F.col(c)).alias(c) for c in ("score_min", "len_dev", "lr_asym", "speed")])


_PELVIS2D = f"""pf0 AS (SELECT s.*, e.l_hip_x AS dl_x, e.l_hip_y AS dl_y, e.r_hip_x AS dr_x, e.r_hip_y AS dr_y,
   greatest(sqrt(power(s.r_hip_x - s.l_hip_x, 2) + power(s.r_hip_y - s.l_hip_y, 2)), 1e-9) AS an FROM skel s JOIN skel e ON e.vec_id = s.vec_id + 1),
pf AS (SELECT *, (r_hip_x - l_hip_x) / an AS ax, (r_hip_y - l_hip_y) / an AS ay, {sdist2(smid('l_shoulder', 'r_shoulder'), smid('l_hip', 'r_hip'))} AS torso FROM pf0),
off AS (SELECT 'l_hip' AS hip, ((dl_x - l_hip_x) * ax + (dl_y - l_hip_y) * ay) / torso AS al, ((dl_y - l_hip_y) * ax - (dl_x - l_hip_x) * ay) / torso AS pe FROM pf WHERE torso > 1e-6 AND clip NOT IN (2, 5)
  UNION ALL SELECT 'r_hip', ((dr_x - r_hip_x) * ax + (dr_y - r_hip_y) * ay) / torso, ((dr_y - r_hip_y) * ax - (dr_x - r_hip_x) * ay) / torso FROM pf WHERE torso > 1e-6 AND clip NOT IN (2, 5)),
om AS (SELECT hip, count(*) AS n, avg(al) AS am, stddev_samp(al) AS asd, avg(pe) AS pm, stddev_samp(pe) AS psd FROM off GROUP BY 1)"""


def hip_offsets(t: Tables) -> DataFrame:
    """Measured on the subjects that are not held out (clips 2 and 5 are)."""
    held = t.embeddings.filter(F.col("label").isin(2, 5)).select(F.col("label").alias("clip")).distinct()
    return ops.measure_offset(paired_skeletons(t).join(held, "clip", "left_anti"), "est_")


@query("a35_pelvis_offset", f"WITH {SKEL}, {_PELVIS2D} SELECT hip, n, {r('am', 5)} AS along_mean, {r('asd', 5)} AS along_sd, {r('pm', 5)} AS perp_mean, {r('psd', 5)} AS perp_sd FROM om")
def _(t):
    out = hip_offsets(t)
    return out.select("hip", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("along_mean", "along_sd", "perp_mean", "perp_sd")])


@query("g16_apply_offset", f"""WITH {SKEL}, {_PELVIS2D},
al AS (SELECT vec_id, l_hip_x, l_hip_y, r_hip_x, r_hip_y, (r_hip_x - l_hip_x) / greatest({sdist2(sv('l_hip'), sv('r_hip'))}, 1e-9) AS ax, (r_hip_y - l_hip_y) / greatest({sdist2(sv('l_hip'), sv('r_hip'))}, 1e-9) AS ay,
  {sdist2(smid('l_shoulder', 'r_shoulder'), smid('l_hip', 'r_hip'))} AS torso FROM skel)
SELECT vec_id, {r('l_hip_x + l.am * torso * ax - l.pm * torso * ay', 4)} AS l_x, {r('l_hip_y + l.am * torso * ay + l.pm * torso * ax', 4)} AS l_y,
  {r('r_hip_x + q.am * torso * ax - q.pm * torso * ay', 4)} AS r_x, {r('r_hip_y + q.am * torso * ay + q.pm * torso * ax', 4)} AS r_y
FROM al, (SELECT * FROM om WHERE hip = 'l_hip') l, (SELECT * FROM om WHERE hip = 'r_hip') q""")
def _(t):
    out = ops.apply_offset(skeletons(t), hip_offsets(t))
    return out.select("vec_id", *[(F.round(F.col(f"{s}_hip_moved")[a], 4) + 0.0).alias(f"{s}_{a}") for s in "lr" for a in "xy"])


@query("g17_blend_tables", f"""WITH {SKEL}, b AS (SELECT s.vec_id, a.alpha, s.r_knee_x * (1 - a.alpha) + e.r_knee_x * a.alpha AS x, s.r_knee_y * (1 - a.alpha) + e.r_knee_y * a.alpha AS y, e.r_knee_x AS ex, e.r_knee_y AS ey
  FROM skel s JOIN skel e ON e.vec_id = s.vec_id + 1, (SELECT unnest([0.0, 0.25, 0.5]::DOUBLE[]) AS alpha) a)
SELECT vec_id, alpha, {r('x')} AS x, {r('y')} AS y, {r('sqrt((x - ex) * (x - ex) + (y - ey) * (y - ey))')} AS pixel_error FROM b""")
def _(t):
    df = grid(paired_skeletons(t), alpha=[0.0, 0.25, 0.5])
    out = ops.blend(df, "r_knee", "est_r_knee", F.col("alpha"))
    return out.select("vec_id", "alpha", r6(F.col("blended")["x"]).alias("x"), r6(F.col("blended")["y"]).alias("y"), r6(F.col("pixel_error")).alias("pixel_error"))


_RREL = " + ".join("sqrt(" + " + ".join(
    f"power((e.{j}_{a} - e.pelvis_{a}) - (s.{j}_{a} - s.pelvis_{a}) / (1 + s.vec_id % 3), 2)" for a in "xyz") + ")" for j in J)


@query("g18_root_relative_error", f"""WITH {SKEL}, er AS (SELECT s.clip, ({_RREL}) / 17 AS err FROM skel s JOIN skel e ON e.vec_id = s.vec_id + 1)
SELECT clip, count(*) AS n, {r('avg(err)')} AS mean_error, {r('quantile_cont(err, 0.5)')} AS median_error FROM er GROUP BY 1""")
def _(t):
    df = ops.root_relative_error(paired_skeletons(t).withColumn("p2mm", (1 + F.col("vec_id") % 3).cast("double")), "est_", "p2mm")
    per = df.select("clip", "mean_error")
    out = per.groupBy("clip").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("mean_error")).alias("mean_error"))
    return out.join(quantiles(per, CLIP, "mean_error", {"median_error": 0.5}).withColumn("median_error", r6(F.col("median_error"))), CLIP)


# ----------------------------------------------------------------- masks, order, scale

_GAP = {j: f"(vec_id * 31 + {i} * 7) % 23 = 0" for i, j in enumerate(J)}


def gapped(t: Tables) -> DataFrame:
    """Skeletons whose flagged joints are missing: NULL, never a zero or a partial mean."""
    return skeletons(t).withColumns({j: F.when(~F.expr(_GAP[j]), F.col(j)) for j in J})


NEED = {s: ["pelvis", "thorax", "l_hip", "r_hip", f"{s}_hip", f"{s}_knee", f"{s}_ankle"] for s in "lr"}


@query("p14_validity_mask", "SELECT vec_id, " + ", ".join(
    "NOT (" + " OR ".join(_GAP[j] for j in NEED[s]) + f") AS valid_{s}" for s in "lr") + " FROM embeddings")
def _(t):
    df = gapped(t)
    masks = {}
    for s, joints in NEED.items():
        ok = F.lit(True)
        for j in joints:
            ok = ok & F.col(j).isNotNull()
        masks[f"valid_{s}"] = ok
    return df.select("vec_id", *[m.alias(n) for n, m in masks.items()])


@query("p15_flagged_sentinel", f"""WITH {SKEL} SELECT vec_id, CASE WHEN NOT {_GAP['l_hip']} THEN {r('l_hip_x')} END AS l_hip_x,
  CASE WHEN NOT ({_GAP['l_hip']} OR {_GAP['r_hip']}) THEN {r('(l_hip_x + r_hip_x) / 2')} END AS mid_x FROM skel""")
def _(t):
    df = gapped(t)
    return df.select("vec_id", r6(F.col("l_hip")["x"]).alias("l_hip_x"), r6(g.middle("l_hip", "r_hip")[0]).alias("mid_x"))


@query("p16_joint_reorder", """SELECT vec_id, list_transform([(p[12] + p[13]) / 2, p[13], p[15], p[17], p[12], p[14], p[16], ((p[12] + p[13]) / 2 + (p[6] + p[7]) / 2) / 2, (p[6] + p[7]) / 2,
    ((p[6] + p[7]) / 2 + p[1]) / 2, p[1], p[6], p[8], p[10], p[7], p[9], p[11]], lambda v: round(v, 6) + 0.0) AS x,
  list_transform([least(s[12], s[13]), s[13], s[15], s[17], s[12], s[14], s[16], least(s[12], s[13], s[6], s[7]), least(s[6], s[7]), least(s[6], s[7], s[1]), s[1], s[6], s[8], s[10], s[7], s[9], s[11]],
    lambda v: round(v, 6) + 0.0) AS score
FROM (SELECT vec_id, list_transform(generate_series(1, 17), lambda i: embedding[i]::DOUBLE) AS p, list_transform(generate_series(18, 34), lambda i: abs(embedding[i]::DOUBLE)) AS s FROM embeddings)""")
def _(t):
    """Seventeen detector points in face-first order to the pelvis-first order."""
    # Detector position of each joint that exists in both orders.
    place = {"head": 0, "l_shoulder": 5, "r_shoulder": 6, "l_elbow": 7, "r_elbow": 8, "l_wrist": 9, "r_wrist": 10,
             "l_hip": 11, "r_hip": 12, "l_knee": 13, "r_knee": 14, "l_ankle": 15, "r_ankle": 16}
    parents = {"pelvis": ("l_hip", "r_hip"), "thorax": ("l_shoulder", "r_shoulder"), "spine": ("pelvis", "thorax"), "neck": ("thorax", "head")}

    def build(array: str, joint: str, combine):
        if joint in place:
            return F.col(array)[place[joint]]
        a, b = parents[joint]
        return combine(build(array, a, combine), build(array, b, combine))
    e = t.embeddings.select(
        "vec_id", F.slice("embedding", 1, 17).cast("array<double>").alias("p"),
        F.transform(F.slice("embedding", 18, 17), lambda v: F.abs(v.cast("double"))).alias("s"))
    return e.select("vec_id", F.array(*[r6(build("p", j, lambda a, b: (a + b) / 2.0)) for j in J]).alias("x"),
                    F.array(*[r6(build("s", j, F.least)) for j in J]).alias("score"))


@query("p17_weight_rescale", f"WITH {SKEL} SELECT vec_id, CASE WHEN abs(pelvis_x) + abs(pelvis_y) > 5 THEN 0.8676::DOUBLE ELSE 0 END AS weight FROM skel")
def _(t):
    seen = (F.abs(F.col("pelvis")["x"]) + F.abs(F.col("pelvis")["y"])) > 5
    return skeletons(t).select("vec_id", F.when(seen, 0.8676).otherwise(0.0).alias("weight"))


_NORMED = ["r_knee", "l_knee", "thorax"]


@query("p18_scale_normalise", f"""WITH {SKEL},
m AS (SELECT clip, max(greatest({', '.join(f'abs({j}_{a} - pelvis_{a})' for j in _NORMED for a in 'xy')})) AS sc FROM skel GROUP BY 1)
SELECT vec_id, {r('sc')} AS scale, """ + ", ".join(f"{r(f'({j}_{a} - pelvis_{a}) / nullif(sc, 0)')} AS {j}_{a}" for j in _NORMED for a in "xy") + " FROM skel JOIN m USING (clip)")
def _(t):
    out = ops.normalise_scale(skeletons(t), CLIP, _NORMED)
    return out.select("vec_id", r6(F.col("scale")).alias("scale"), *[r6(F.col(j)[a]).alias(f"{j}_{a}") for j in _NORMED for a in "xy"])


IMAGE = (1.6, 0.9)


@query("p18_image_normalise", f"WITH {SKEL} SELECT vec_id, " + ", ".join(
    f"{r(f'{j}_x / {IMAGE[0]}::DOUBLE * 2 - 1')} AS {j}_x, {r(f'{j}_y / {IMAGE[0]}::DOUBLE * 2 - {IMAGE[1]}::DOUBLE / {IMAGE[0]}::DOUBLE')} AS {j}_y" for j in _NORMED) + " FROM skel")
def _(t):
    """Points by the size of their image, which keeps their place in it."""
    out = ops.normalise_image(skeletons(t), _NORMED, *[F.lit(v) for v in IMAGE])
    return out.select("vec_id", *[r6(F.col(j)[a]).alias(f"{j}_{a}") for j in _NORMED for a in "xy"])


RECIPE = {"pelvis": ["l_hip", "r_hip"], "thorax": ["neck", "l_shoulder", "r_shoulder"], "head": ["head"]}


@query("p24_recipe_points", f"WITH {SKEL} " + " UNION ALL ".join(
    f"SELECT vec_id, '{p}' AS point, CASE WHEN NOT (" + " OR ".join(_GAP[j] for j in js) + f") THEN {r('(' + ' + '.join(f'{j}_x' for j in js) + f') / {len(js)}')} END AS x FROM skel"
    for p, js in RECIPE.items()))
def _(t):
    """Mean of a recipe's points, NULL if any is missing."""
    df = gapped(t)
    points = F.array(*[F.struct(F.lit(p).alias("point"), r6(g.middle(*js)[0]).alias("x")) for p, js in RECIPE.items()])
    return df.select("vec_id", F.inline(points))


# ------------------------------------------------------------------------ body model

MODEL = LENGTHS + """,
model AS (SELECT clip, segment, quantile_cont(length, 0.5) AS length FROM len GROUP BY 1, 2)"""


@query("a23_body_model", f"WITH {SKEL}, {MODEL} SELECT clip, segment, {r('length')} AS length FROM model")
def _(t):
    out = ops.body_model(ops.lengths(skeletons(t)), CLIP)
    return out.withColumn("length", r6(F.col("length")))


@query("a23_length_ratios", f"WITH {SKEL}, {MODEL} " + " UNION ALL ".join(
    f"SELECT a.clip, '{n}' AS ratio, {r('a.length / nullif(b.length, 0)')} AS value FROM model a JOIN model b USING (clip) WHERE a.segment = '{p}' AND b.segment = '{q}'"
    for n, (p, q) in g.RATIOS.items()))
def _(t):
    out = ops.length_ratios(ops.body_model(ops.lengths(skeletons(t)), CLIP), CLIP)
    return out.withColumn("value", r6(F.col("value")))


@query("a34_gap_cost", "WITH f AS (SELECT vec_id, " + ", ".join(f"{e} AS g_{j}" for j, e in _GAP.items()) + """ FROM embeddings)
SELECT 'any joint' AS what, count(*) FILTER (WHERE """ + " OR ".join(f"g_{j}" for j in J) + ") AS n_lost, round(avg(CASE WHEN " + " OR ".join(f"g_{j}" for j in J) + " THEN 1.0 ELSE 0 END), 6) AS share FROM f " +
    " ".join(f"UNION ALL SELECT 'angles {s}', count(*) FILTER (WHERE " + " OR ".join(f"g_{j}" for j in NEED[s]) + "), round(avg(CASE WHEN " + " OR ".join(f"g_{j}" for j in NEED[s]) + " THEN 1.0 ELSE 0 END), 6) FROM f" for s in "lr") + " " +
    " ".join(f"UNION ALL SELECT '{j}', count(*) FILTER (WHERE g_{j}), round(avg(CASE WHEN g_{j} THEN 1.0 ELSE 0 END), 6) FROM f" for j in J))
def _(t):
    """Rows lost to gaps if excluded globally, per angle, and per joint; one pass."""
    df = gapped(t)

    def lost(joints):
        test = F.lit(False)
        for j in joints:
            test = test | F.col(j).isNull()
        return test
    cases = {"any joint": lost(J), **{f"angles {s}": lost(NEED[s]) for s in "lr"}, **{j: lost([j]) for j in J}}
    sums = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(cases.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("what"), F.col(f"_{i}").alias("n_lost"), r6(F.col(f"_{i}") / F.col("_n")).alias("share")) for i, n in enumerate(cases)])
    return sums.select(F.inline(rows))


_TARGETS = ["r_hip", "r_knee", "r_ankle", "l_hip", "l_knee", "l_ankle"]


@query("a41_nearest_slot", f"""WITH {SKEL}, d AS (""" + " UNION ALL ".join(
    f"SELECT '{a}' AS target, '{b}' AS slot, {i} AS o, sqrt(power(s.{a}_x - e.{b}_x, 2) + power(s.{a}_y - e.{b}_y, 2)) AS d FROM skel s JOIN skel e ON e.vec_id = s.vec_id + 1"
    for a in _TARGETS for i, b in enumerate(J)) + f"""),
m AS (SELECT target, slot, o, quantile_cont(d, 0.5) AS m FROM d GROUP BY 1, 2, 3)
SELECT target, slot, {r('m')} AS distance, slot <> target AS mismatch FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY round(m, 9), o) AS rn FROM m) WHERE rn = 1""")
def _(t):
    out = ops.nearest_slots(paired_skeletons(t), _TARGETS, J, "est_")
    return out.withColumn("distance", r6(F.col("distance")))


# ---------------------------------------------------------------------------- travel

@query("w14_travel_azimuth", f"""WITH {SKEL},
m AS (SELECT clip, lead(pelvis_x, 10) OVER w - pelvis_x AS vx, lead(pelvis_y, 10) OVER w - pelvis_y AS vy, (lead(pelvis_x, 10) OVER w + pelvis_x) / 2 - 40 AS sx, (lead(pelvis_y, 10) OVER w + pelvis_y) / 2 + 25 AS sy
  FROM skel WINDOW w AS (PARTITION BY clip ORDER BY frame)),
a AS (SELECT clip, degrees(acos(least(1.0::DOUBLE, abs(vx * sx + vy * sy) / (sqrt(vx * vx + vy * vy) * sqrt(sx * sx + sy * sy))))) AS d FROM m WHERE sqrt(vx * vx + vy * vy) > 1e-3 AND sqrt(sx * sx + sy * sy) > 1e-3)
SELECT clip, count(d) AS n, CASE WHEN count(d) >= 5 THEN {r('quantile_cont(d, 0.5)', 5)} END AS deg, CASE WHEN count(d) >= 5 THEN {r('quantile_cont(d, 0.25)', 5)} END AS p25, CASE WHEN count(d) >= 5 THEN {r('quantile_cont(d, 0.75)', 5)} END AS p75 FROM a GROUP BY 1""")
def _(t):
    out = ops.travel_azimuth(clip_skeletons(t), CLIP, (40.0, -25.0))
    return out.select("clip", "n", *[(F.round(c, 5) + 0.0).alias(c) for c in ("deg", "p25", "p75")])


TRAVEL = """steps AS (SELECT clip, pelvis_x - lag(pelvis_x) OVER (PARTITION BY clip ORDER BY frame) AS dx, abs(l_hip_x - r_hip_x) AS hw, abs(thorax_y - pelvis_y) AS tl FROM skel),
travel AS (SELECT clip, count(*) AS n, CASE WHEN count(*) >= 3 THEN quantile_cont(dx, 0.5) / CASE WHEN quantile_cont(hw, 0.5) >= 1e-6 THEN quantile_cont(hw, 0.5) WHEN quantile_cont(tl, 0.5) >= 1e-6 THEN quantile_cont(tl, 0.5) END END AS dx FROM steps GROUP BY 1)"""


@query("w15_signed_travel", f"WITH {SKEL}, {TRAVEL} SELECT clip, n, {r('dx')} AS dx_per_frame FROM travel")
def _(t):
    return ops.travel_per_frame(clip_skeletons(t), CLIP).withColumn("dx_per_frame", r6(F.col("dx_per_frame")))


@query("w19_excursion", f"WITH {SKEL} SELECT clip, {r('(max(pelvis_x) - min(pelvis_x)) / quantile_cont(' + sdist('thorax', 'pelvis') + ', 0.5)')} AS excursion FROM skel GROUP BY 1")
def _(t):
    return ops.excursion(skeletons(t), CLIP).withColumn("excursion", r6(F.col("excursion")))


@query("w19_anterior_offset", f"""WITH {SKEL}, m AS (SELECT clip, quantile_cont({sdist('thorax', 'pelvis')}, 0.5) AS t FROM skel GROUP BY 1)
SELECT clip, frame, {r('(r_ankle_x - pelvis_x) / t')} AS "offset" FROM skel JOIN m USING (clip)""")
def _(t):
    return ops.anterior_offset(clip_skeletons(t), CLIP, "r").withColumn("offset", r6(F.col("offset")))
