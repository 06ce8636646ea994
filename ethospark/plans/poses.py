"""Pose, kinematics and social queries.

Stand-ins: a session is three users with successive ids, an animal is one of them, a frame is the user's n-th event. A part's place is a
linear form of the event's value and the last two digits of its id (PARTS), its likelihood is least(value / 100, 1).
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..functions import names as N
from ..operators import kinematics as K, social as S
from .behaviour import CTE, FPS, WINDOWS, frames, table, windows
from .registry import register

#: part: (a, b, c, d) with x = a * value + b and y = c * digits + d.
PARTS = {"nose": (1.0, 0.0, 1.0, 0.0), "left_ear": (0.75, 5.0, 0.5, 20.0), "right_ear": (0.5, 15.0, 0.75, 8.0), "center": (0.25, 30.0, 0.25, 30.0), "tail_base": (-0.25, 60.0, -0.25, 70.0), "paw_l": (0.5, 25.0, 1.0, 3.0), "paw_r": (1.0, 7.0, 0.5, 9.0)}
NAMES = list(PARTS)
KEYS = ["session", "animal"]
_XY = ", ".join(f"value * {a}::DOUBLE + {b}::DOUBLE AS {p}_x, k * {c}::DOUBLE + {d}::DOUBLE AS {p}_y" for p, (a, b, c, d) in PARTS.items())
POSE = CTE + f", z AS (SELECT user_id // 3 AS session, (user_id % 3)::INT AS animal, frame, p, {_XY} FROM (SELECT *, (event_id % 100)::DOUBLE AS k FROM f))"
_W = "(PARTITION BY session, animal ORDER BY frame)"


def pose(spark, d):
    v, k = F.col("value"), (F.col("event_id") % 100).cast("double")
    cols = [c for q, (a, b, m, n) in PARTS.items() for c in ((v * a + b).alias(f"{q}_x"), (k * m + n).alias(f"{q}_y"), F.col("p").alias(f"{q}_likelihood"))]
    return frames(spark, d).select(F.floor(F.col("user_id") / 3).alias("session"), (F.col("user_id") % 3).cast("int").alias("animal"), "frame", *cols)


def rounded(df, digits, *cols):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@register("pose_long", POSE + ", l AS (" + " UNION ALL ".join(f"SELECT session, animal, frame, '{q}' AS bodypart, {q}_x AS x, {q}_y AS y, p AS likelihood FROM z" for q in PARTS) + ") SELECT session, animal, frame, bodypart, round(x, 6) AS x, round(y, 6) AS y, round(likelihood, 6) AS likelihood FROM l")
def pose_long(spark, d):
    """The canonical schema: one row a part and frame."""
    parts = F.array(*(F.struct(F.lit(q).alias("bodypart"), *(F.round(f"{q}_{c}", 6).alias(c) for c in ("x", "y", "likelihood"))) for q in NAMES))
    return pose(spark, d).select(*KEYS, "frame", F.explode(parts).alias("r")).select(*KEYS, "frame", "r.*")


_MEAN = {c: "(" + " + ".join(f"{q}_{c}" for q in PARTS) + f") / {len(PARTS)}" for c in "xy"}


@register("pose_centroid", POSE + f" SELECT session, animal, frame, round({_MEAN['x']}, 6) AS cx, round({_MEAN['y']}, 6) AS cy FROM z")
def pose_centroid(spark, d):
    """All parts have one likelihood here, so the threshold falls back to all of them or takes all."""
    cx, cy = K.centroid(NAMES, 0.2)
    return pose(spark, d).select(*KEYS, "frame", F.round(cx, 6).alias("cx"), F.round(cy, 6).alias("cy"))


MOVING = ("nose", "center")


def _diff(c):
    return f"CASE WHEN frame = 0 THEN 0 ELSE ({c} - lag({c}) OVER w) * 30 END"


def _motion(parts):
    one = ", ".join(f"{_diff(f'{q}_{c}')} AS v{c}_{q}" for q in parts for c in "xy")
    two = ", ".join(f"{_diff(f'v{c}_{q}')} AS a{c}_{q}" for q in parts for c in "xy")
    three = ", ".join(f"sqrt(ax_{q} * ax_{q} + ay_{q} * ay_{q}) AS acc_{q}" for q in parts)
    return f", m1 AS (SELECT *, atan2(nose_y - tail_base_y, nose_x - tail_base_x) AS axis, {one} FROM z WINDOW w AS {_W}), m2 AS (SELECT *, {two} FROM m1 WINDOW w AS {_W}), m3 AS (SELECT *, {three} FROM m2)"


@register("part_motion", POSE + _motion(MOVING) + " SELECT session, animal, frame, " + ", ".join(f"round(vx_{q}, 4) AS {q}_velocity_x, round(vy_{q}, 4) AS {q}_velocity_y, round(sqrt(vx_{q} * vx_{q} + vy_{q} * vy_{q}), 4) AS {q}_speed, round(acc_{q}, 4) AS {q}_acceleration, round({_diff(f'acc_{q}')}, 3) AS {q}_jerk, round(vx_{q} * cos(axis) + vy_{q} * sin(axis), 4) AS {q}_forward_velocity, round(vy_{q} * cos(axis) - vx_{q} * sin(axis), 4) AS {q}_lateral_velocity" for q in MOVING) + f" FROM m3 WINDOW w AS {_W}")
def part_motion(spark, d):
    df = pose(spark, d)
    out = K.part_motion(df.withColumn("__a", F.lit(0)), KEYS, NAMES, FPS)
    kinds = ("velocity_x", "velocity_y", "speed", "acceleration", "forward_velocity", "lateral_velocity")
    return out.select(*KEYS, "frame", *(F.round(f"{q}_{k}", 4).alias(f"{q}_{k}") for q in MOVING for k in kinds), *(F.round(f"{q}_jerk", 3).alias(f"{q}_jerk") for q in MOVING))


_LENGTH = "sqrt(pow(nose_x - tail_base_x, 2) + pow(nose_y - tail_base_y, 2))"


@register("body_axis_length", POSE + f" SELECT session, animal, frame, round(atan2(nose_y - tail_base_y, nose_x - tail_base_x), 6) AS axis, round(CASE WHEN {_LENGTH} > 1 THEN {_LENGTH} END, 6) AS body_length FROM z")
def body_axis_length(spark, d):
    return pose(spark, d).select(*KEYS, "frame", F.round(K.body_axis(NAMES), 6).alias("axis"), F.round(K.body_length(NAMES), 6).alias("body_length"))


_PAIRS = [tuple(sorted((a, b))) for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]]
_DIST = {f"dist_{a}_to_{b}": f"sqrt(pow({a}_x - {b}_x, 2) + pow({a}_y - {b}_y, 2))" for a, b in _PAIRS}
_BL = f"CASE WHEN {_LENGTH} > 1 THEN {_LENGTH} END"


@register("pair_distances", POSE + f", b AS (SELECT *, {_BL} AS bl FROM z) SELECT session, animal, frame, " + ", ".join(f"round({e}, 5) AS {n}" + ("" if n == "dist_nose_to_tail_base" else f", round({e} / bl, 5) AS {n}_norm") for n, e in _DIST.items()) + ", round(bl, 5) AS body_length_px FROM b")
def pair_distances(spark, d):
    out = K.pair_distances(pose(spark, d), NAMES)
    return out.select(*KEYS, "frame", *(F.round(c, 5).alias(c) for c in out.columns if c.startswith("dist_") or c == "body_length_px"))


@register("head_direction", POSE + f""", h AS (SELECT *, atan2(nose_y - (left_ear_y + right_ear_y) / 2, nose_x - (left_ear_x + right_ear_x) / 2) AS a, {_diff('nose_x')} AS vx, {_diff('nose_y')} AS vy FROM z WINDOW w AS {_W}), g AS (SELECT *, a - lag(a) OVER w AS turn FROM h WINDOW w AS {_W})
SELECT session, animal, frame, round(a, 5) AS head_direction_angle, round(abs(coalesce(atan2(sin(turn), cos(turn)) * 30, 0)), 4) AS head_turn, round(vx * cos(a) + vy * sin(a), 4) AS head_forward_speed, round(vy * cos(a) - vx * sin(a), 4) AS head_lateral_speed, round(sqrt(pow(left_ear_x - right_ear_x, 2) + pow(left_ear_y - right_ear_y, 2)), 5) AS ear_spread FROM g""")
def head_direction(spark, d):
    out = K.head_direction(pose(spark, d), KEYS, NAMES, FPS)
    return out.select(*KEYS, "frame", *(F.round(c, n).alias(c) for c, n in (("head_direction_angle", 5), ("head_forward_speed", 4), ("head_lateral_speed", 4), ("ear_spread", 5))), F.round(F.abs("head_angular_velocity"), 4).alias("head_turn"))


def _angle(a, j, b):
    dot = f"(({a}_x - {j}_x) * ({b}_x - {j}_x) + ({a}_y - {j}_y) * ({b}_y - {j}_y))"
    size = f"(sqrt(pow({a}_x - {j}_x, 2) + pow({a}_y - {j}_y, 2)) * sqrt(pow({b}_x - {j}_x, 2) + pow({b}_y - {j}_y, 2)))"
    return f"round(CASE WHEN {size} > 1e-9 THEN acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, {dot} / {size}))) END, 4)"


@register("joint_angles", POSE + f" SELECT session, animal, frame, {_angle('nose', 'center', 'tail_base')} AS joint_angle_spine_flexion, {_angle('nose', 'left_ear', 'center')} AS joint_angle_head_neck_angle, {_angle('paw_l', 'center', 'paw_r')} AS joint_angle_forelimb_spread FROM z")
def joint_angles(spark, d):
    return pose(spark, d).select(*KEYS, "frame", *(F.round(c, 4).alias(n) for n, c in K.joint_angles(NAMES).items()))


@register("spine_curvature", POSE + " , t AS (SELECT *, atan2(center_y - nose_y, center_x - nose_x) - atan2(tail_base_y - center_y, tail_base_x - center_x) AS t FROM z) SELECT session, animal, frame, round(abs(atan2(sin(t), cos(t))), 5) AS spine_curvature FROM t")
def spine_curvature(spark, d):
    return pose(spark, d).select(*KEYS, "frame", F.round(K.curvature(["nose", "center", "tail_base"]), 5).alias("spine_curvature"))


_SPEED = f", s AS (SELECT session, animal, frame, sqrt(pow({_diff('nose_x')}, 2) + pow({_diff('nose_y')}, 2)) AS speed FROM z WINDOW w AS {_W})"


def nose_speed(spark, d):
    w = Window.partitionBy(*KEYS).orderBy("frame")
    return pose(spark, d).select(*KEYS, "frame", F.sqrt(K.change(F.col("nose_x"), w, FPS) ** 2 + K.change(F.col("nose_y"), w, FPS) ** 2).alias("speed"))


@register("oscillation_energy", POSE + _SPEED + ", o AS (SELECT *, pow(speed - avg(speed) OVER (PARTITION BY session, animal), 2) AS power FROM s) SELECT session, animal, frame, round(power, 1) AS nose_oscillation_power, round(sum(power) OVER (PARTITION BY session, animal ORDER BY frame ROWS BETWEEN 15 PRECEDING AND 14 FOLLOWING) / 30, 1) AS nose_oscillation_energy FROM o")
def oscillation_energy(spark, d):
    out = K.oscillation(nose_speed(spark, d), KEYS, "speed", 30, "nose")
    return rounded(out.drop("speed"), 1, "nose_oscillation_power", "nose_oscillation_energy")


@register("rhythm_features", POSE + _SPEED + """, a AS (SELECT session, animal, frame, list(speed) OVER (PARTITION BY session, animal ORDER BY frame ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) AS v FROM s), c AS (SELECT session, animal, frame, list_transform(v, lambda x: x - list_avg(v)) AS c FROM a),
e AS (SELECT *, len(c) AS n, list_sum(list_transform(c, lambda x: x * x)) AS power FROM c),
k AS (SELECT session, animal, frame, n, power, k, list_sum(list_transform(range(1, n + 1 - k), lambda i: c[i] * c[i + k])) AS ac, sqrt(pow(list_sum(list_transform(range(1, n + 1), lambda i: c[i] * cos(2 * pi() * k * (i - 1) / n))), 2) + pow(list_sum(list_transform(range(1, n + 1), lambda i: c[i] * sin(2 * pi() * k * (i - 1) / n))), 2)) AS mag FROM e, LATERAL (SELECT unnest(range(1, n)) AS k) x),
g AS (SELECT session, animal, frame, any_value(n) AS n, any_value(power) AS power, max(ac) AS peak, arg_max(k, mag) FILTER (k <= n // 2) AS f FROM k GROUP BY ALL) SELECT session, animal, frame, round(CASE WHEN n >= 4 AND power / n > 1e-9 THEN peak / power ELSE 0 END, 5) AS nose_autocorr_peak, round(CASE WHEN n >= 8 THEN f * 30.0::DOUBLE / n ELSE 0 END, 5) AS nose_frequency FROM g""".replace("GROUP BY ALL) SELECT", "GROUP BY session, animal, frame) SELECT"))
def rhythm_features(spark, d):
    out = K.rhythm(nose_speed(spark, d), KEYS, "speed", FPS, 12, "nose")
    return rounded(out.drop("speed"), 5, "nose_autocorr_peak", "nose_frequency")


@register("window_periodicity", WINDOWS + """, c AS (SELECT user_id, win, pos, value - avg(value) OVER (PARTITION BY user_id, win) AS c FROM x), k AS (SELECT unnest(range(1, 9)) AS k),
m AS (SELECT user_id, win, k, sqrt(pow(sum(c * cos(2 * pi() * k * pos / 16)), 2) + pow(sum(c * sin(2 * pi() * k * pos / 16)), 2)) AS m, sum(c * c) / 16 AS var FROM c, k GROUP BY user_id, win, k) SELECT user_id, win AS "window", round(CASE WHEN any_value(var) <= 1e-10 THEN 0 ELSE max(m) END, 5) AS value_periodicity FROM m GROUP BY user_id, win""")
def window_periodicity(spark, d):
    return rounded(K.periodicity(windows(spark, d), ["user_id"], "value"), 5, "value_periodicity")


_BASES = S.DISTANCES + S.DIRECTIONS
_BOX = ", ".join(f"{f}({', '.join(f'{q}_{c}' for q in PARTS)}) AS {c}{n}" for c in "xy" for n, f in ((0, "least"), (1, "greatest")))
SOCIAL = POSE + f""", own AS (SELECT *, {_MEAN['x']} AS cx, {_MEAN['y']} AS cy, atan2(nose_y - tail_base_y, nose_x - tail_base_x) AS axis, {_BL} AS bl, {_BOX}, [{', '.join(f'[{q}_x, {q}_y]' for q in PARTS)}] AS place FROM z),
vel AS (SELECT *, {_diff('cx')} AS cvx, {_diff('cy')} AS cvy FROM own WINDOW w AS {_W}),
dy AS (SELECT a.session, a.animal, a.frame, b.animal AS other, a.bl, sqrt(pow(a.cx - b.cx, 2) + pow(a.cy - b.cy, 2)) AS dist_centroid_to_centroid, sqrt(pow(a.nose_x - b.nose_x, 2) + pow(a.nose_y - b.nose_y, 2)) AS dist_nose_to_nose, sqrt(pow(a.nose_x - b.tail_base_x, 2) + pow(a.nose_y - b.tail_base_y, 2)) AS dist_nose_to_tail_base,
  list_min(list_transform(a.place, lambda s: list_min(list_transform(b.place, lambda t: sqrt(pow(s[1] - t[1], 2) + pow(s[2] - t[2], 2)))))) AS min_keypoint_dist,
  atan2(b.cy - a.cy, b.cx - a.cx) - a.axis AS fa, atan2(a.cy - b.cy, a.cx - b.cx) - b.axis AS ofa, a.axis - b.axis AS ha, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS inter,
  (a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) AS areas, a.cvx * (b.cx - a.cx) + a.cvy * (b.cy - a.cy) AS along FROM vel a JOIN vel b ON a.session = b.session AND a.frame = b.frame AND a.animal <> b.animal),
dz AS (SELECT *, abs(atan2(sin(fa), cos(fa))) AS facing_angle, abs(atan2(sin(ofa), cos(ofa))) AS other_facing_focal, CASE WHEN areas - inter > 0 THEN inter / (areas - inter) END AS bbox_overlap, cos(ha) AS heading_alignment, CASE WHEN dist_centroid_to_centroid > 1e-6 THEN along / dist_centroid_to_centroid END AS radial_velocity_toward,
  -(CASE WHEN row_number() OVER o = 1 THEN 0 ELSE (dist_centroid_to_centroid - lag(dist_centroid_to_centroid) OVER o) * 30 END) AS approach_velocity FROM dy WINDOW o AS (PARTITION BY session, animal, other ORDER BY frame)),
rk AS (SELECT *, row_number() OVER (PARTITION BY session, animal, frame ORDER BY dist_centroid_to_centroid, other) AS rk FROM dz),
so AS (SELECT session, animal, frame, any_value(bl) AS bl, {', '.join(f'avg({b}) AS {b}_mean, max({b}) FILTER (rk = 1) AS {b}_nearest' for b in _BASES)} FROM rk GROUP BY session, animal, frame),
ct AS (SELECT *, coalesce(min_keypoint_dist_nearest <= 0.5 * bl, false) AS contact, row_number() OVER {_W} - 1 AS i FROM so), cd AS (SELECT *, CASE WHEN contact THEN (i - coalesce(max(CASE WHEN NOT contact THEN i END) OVER (PARTITION BY session, animal ORDER BY frame), 0)) / 30.0::DOUBLE ELSE 0 END AS duration FROM ct)"""


@register("social_features", SOCIAL + " SELECT session, animal, frame, " + ", ".join(f"round({b}_{k}, 4) AS social_{b}_{k}" for b in _BASES for k in ("mean", "nearest")) + ", " + ", ".join(f"round({b}_{k} / bl, 4) AS social_{b}_{k}_norm" for b in S.DISTANCES for k in ("mean", "nearest")) + ", contact::DOUBLE AS social_in_contact, round(duration, 5) AS social_in_contact_duration_s FROM cd")
def social_features(spark, d):
    out = S.social_features(pose(spark, d), "session", NAMES, FPS)
    digits = lambda c: c if c == "social_in_contact" else F.round(c, 5 if c.endswith("_s") else 4).alias(c)
    return out.select(*KEYS, "frame", *(digits(c) for c in out.columns if c.startswith("social_")))


@register("social_summary", SOCIAL + """, e AS (SELECT *, contact AND NOT coalesce(lag(contact) OVER (PARTITION BY session, animal ORDER BY frame), false) AS rise FROM cd)
SELECT session, animal, count(*) AS n_frames, round(avg(dist_centroid_to_centroid_nearest / bl), 5) AS mean_distance_norm, round(avg(dist_centroid_to_centroid_nearest), 5) AS mean_distance_px, round(count(*) FILTER (contact) / 30.0, 5) AS contact_time_s, round(avg(contact::INT), 5) AS contact_fraction, count(*) FILTER (rise) AS n_contact_bouts,
round(CASE WHEN count(*) FILTER (rise) > 0 THEN count(*) FILTER (contact) / 30.0 / count(*) FILTER (rise) ELSE 0 END, 5) AS mean_contact_bout_s, round(avg(approach_velocity_nearest), 4) AS mean_approach_velocity, round(avg(radial_velocity_toward_nearest), 4) AS mean_radial_velocity_toward, round(avg((radial_velocity_toward_nearest > 0)::INT), 5) AS advance_fraction,
round(avg(facing_angle_nearest), 5) AS mean_facing_angle, round(avg(heading_alignment_nearest), 5) AS mean_heading_alignment FROM e GROUP BY session, animal""")
def social_summary(spark, d):
    out = S.summary(S.social_features(pose(spark, d), "session", NAMES, FPS), KEYS, FPS)
    return out.select(*KEYS, "n_frames", "n_contact_bouts", *(F.round(c, 4 if "velocity" in c else 5).alias(c) for c in out.columns if c not in (*KEYS, "n_frames", "n_contact_bouts")))


#: Stand-in of a state sequence: ten frames of each of four states in turn.
_STATES = SOCIAL + """, st AS (SELECT *, ((frame // 10) % 4)::INT AS state FROM cd), pf AS (SELECT state, avg(dist_centroid_to_centroid_nearest) AS distance, avg(contact::INT) AS contact, count(*) AS n FROM st GROUP BY state), ne AS (SELECT state FROM pf WHERE distance <= (SELECT median(distance) FROM pf))"""


def _stated(spark, d):
    return S.social_features(pose(spark, d), "session", NAMES, FPS).withColumn("state", (F.floor(F.col("frame") / 10) % 4).cast("int"))


def _profiles(df):
    return df.groupBy("state").agg(F.avg("social_dist_centroid_to_centroid_nearest").alias("distance"), F.avg("social_in_contact").alias("contact"), F.count(F.lit(1)).alias("n"))


@register("state_profiles", _STATES + " SELECT pf.state, round(distance, 5) AS distance, round(contact, 5) AS contact, n, ne.state IS NOT NULL AS interaction FROM pf LEFT JOIN ne ON pf.state = ne.state")
def state_profiles(spark, d):
    p = _profiles(_stated(spark, d))
    near = S.interaction_states(p, "distance", "contact").select("state", F.lit(True).alias("interaction"))
    return p.join(near, "state", "left").select("state", F.round("distance", 5).alias("distance"), F.round("contact", 5).alias("contact"), "n", F.coalesce("interaction", F.lit(False)).alias("interaction"))


@register("displacement_dominance", _STATES + """, r AS (SELECT session, animal, CASE WHEN state IN (SELECT state FROM ne) THEN radial_velocity_toward_nearest END AS r FROM st),
g AS (SELECT session, animal, count(r) / 30.0 AS t, coalesce(avg(r), 0) AS adv, coalesce(avg((r < 0)::INT), 0) AS y, avg(r) - avg((r < 0)::INT) AS s FROM r GROUP BY session, animal), k AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY s DESC NULLS LAST, animal) AS rank, count(*) OVER (PARTITION BY session) AS n FROM g)
SELECT session, animal, round(t, 5) AS interaction_time_s, round(adv, 4) AS mean_advance, round(y, 5) AS yield_fraction, round(s, 4) AS dominance_score, rank AS dominance_rank, rank = 1 AND n > 1 AS is_dominant FROM k""")
def displacement_dominance(spark, d):
    df = _stated(spark, d)
    near = S.interaction_states(_profiles(df), "distance", "contact").select("state", F.lit(True).alias("used"))
    out = S.dominance(df.join(F.broadcast(near), "state", "left"), "session", F.coalesce("used", F.lit(False)), FPS)
    return out.select(*KEYS, F.round("interaction_time_s", 5).alias("interaction_time_s"), F.round("mean_advance", 4).alias("mean_advance"), F.round("yield_fraction", 5).alias("yield_fraction"), F.round("dominance_score", 4).alias("dominance_score"), "dominance_rank", "is_dominant")


SWAPS = POSE + f""", c AS (SELECT session, animal, frame, {_MEAN['x']} AS cx, {_MEAN['y']} AS cy FROM z), s AS (SELECT *, lag(cx) OVER w AS px, lag(cy) OVER w AS py FROM c WINDOW w AS {_W}), o AS (SELECT *, sqrt(pow(cx - px, 2) + pow(cy - py, 2)) AS own FROM s WHERE px IS NOT NULL),
l AS (SELECT session, greatest(15, 4 * median(own)) AS lim FROM o GROUP BY session), j AS (SELECT a.session, a.animal AS a, b.animal AS b, a.frame FROM o a JOIN o b ON a.session = b.session AND a.frame = b.frame AND a.animal < b.animal JOIN l ON l.session = a.session
WHERE sqrt(pow(a.cx - b.px, 2) + pow(a.cy - b.py, 2)) + sqrt(pow(b.cx - a.px, 2) + pow(b.cy - a.py, 2)) < a.own + b.own AND greatest(a.own, b.own) > lim)"""


@register("identity_swaps", SWAPS + " SELECT * FROM j")
def identity_swaps(spark, d):
    return S.identity_swaps(pose(spark, d), "session", NAMES)


@register("identity_corrections", SWAPS + """, q AS (SELECT z.session, z.frame, z.animal AS source, coalesce((SELECT list((j.a * 10 + j.b) ORDER BY j.frame, j.a, j.b) FROM j WHERE j.session = z.session AND j.frame <= z.frame), []::INT[]) AS st FROM z)
SELECT session, frame, source, list_reduce(list_prepend(source, st), lambda who, s: CASE WHEN who = s // 10 THEN s % 10 WHEN who = s % 10 THEN s // 10 ELSE who END)::INT AS animal FROM q""")
def identity_corrections(spark, d):
    p = pose(spark, d)
    return S.apply_swaps(p.withColumn("source", F.col("animal")), "session", S.identity_swaps(p, "session", NAMES)).select("session", "frame", "source", "animal")


# Names.
_STEM = "lower(replace(p_name, ' ', '_'))"


@register("canonical_distances", """WITH n AS (SELECT p_partkey, 'dist_' || lower(split_part(p_name, ' ', 1)) || '_to_' || lower(split_part(p_type, ' ', 1)) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '_norm' WHEN 2 THEN '_mean' ELSE '_norm_p90' END AS name, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_type, ' ', 1)) AS b, p_size FROM part)
SELECT p_partkey, name, 'dist_' || least(a, b) || '_to_' || greatest(a, b) || CASE p_size % 4 WHEN 0 THEN '' WHEN 1 THEN '_norm' WHEN 2 THEN '_mean' ELSE '_norm_p90' END AS canonical FROM n""")
def canonical_distances(spark, d):
    p = table(spark, d, "part")
    tail = F.element_at(F.array(*map(F.lit, ("", "_norm", "_mean", "_norm_p90"))), (F.col("p_size") % 4 + 1).cast("int"))
    name = F.concat(F.lit("dist_"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit("_to_"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1))), tail)
    return p.select("p_partkey", name.alias("name"), N.distance_name_column(name).alias("canonical"))


_FEATURE = "CASE p_size % 7 WHEN 0 THEN 'social_' WHEN 1 THEN 'flow_' WHEN 2 THEN 'roi2_' WHEN 3 THEN 'nose_velocity_' WHEN 4 THEN 'to_target_' WHEN 5 THEN 'heroic_' ELSE '' END || lower(replace(p_type, ' ', '_'))"


@register("feature_families", f"""WITH n AS (SELECT {_FEATURE} AS f FROM part), c AS (SELECT f, CASE WHEN starts_with(f, 'social_') THEN 'social' WHEN regexp_matches(f, 'flow|surface|r3d|optical|video|pixel|texture|local') THEN 'video' WHEN regexp_matches(f, 'target|occup') OR regexp_matches(f, '(^|[^a-z0-9])(roi|zone|arena|wall|corner|env)[0-9]*([^a-z0-9]|$)') THEN 'context'
WHEN regexp_matches(f, 'velocity|speed|accel|jerk|displacement|distance|angularvel|momentum') THEN 'kinematics' ELSE 'pose' END AS family FROM n) SELECT family, count(*) AS n, count(DISTINCT f) AS names FROM c GROUP BY family""")
def feature_families(spark, d):
    head = F.element_at(F.array(*map(F.lit, ("social_", "flow_", "roi2_", "nose_velocity_", "to_target_", "heroic_", ""))), (F.col("p_size") % 7 + 1).cast("int"))
    f = table(spark, d, "part").select(F.concat(head, F.lower(F.replace("p_type", F.lit(" "), F.lit("_")))).alias("f"))
    return f.groupBy(N.family_column(F.col("f")).alias("family")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("f").alias("names"))


_POSE_STEM = "replace(p_name, ' ', '_') || CASE p_size % 5 WHEN 0 THEN '.mp4_SLEAP' WHEN 1 THEN 'DLC_resnet50' WHEN 2 THEN '_tracked' WHEN 3 THEN '_.movDLC_x' ELSE '' END"


@register("match_keys", f"""WITH v AS (SELECT p_partkey, lower({_POSE_STEM}) AS s, p_size FROM part) SELECT p_partkey, regexp_replace(CASE WHEN regexp_matches(s, '^.+?\\.(mp4|avi|mov|mkv)([^a-z0-9].*)?$') THEN regexp_extract(s, '^(.+?)\\.(mp4|avi|mov|mkv)([^a-z0-9].*)?$', 1) WHEN regexp_matches(s, '^.+?dlc_') THEN regexp_extract(s, '^(.+?)dlc_', 1)
WHEN regexp_matches(s, '_(dlc|pose|tracking|tracked|labeled)$') THEN regexp_extract(s, '^(.+)_(dlc|pose|tracking|tracked|labeled)$', 1) ELSE s END, CASE WHEN p_size % 5 = 4 THEN '$^' ELSE '[-_ .]+$' END, '') AS match_key FROM v""")
def match_keys(spark, d):
    tail = F.element_at(F.array(*map(F.lit, (".mp4_SLEAP", "DLC_resnet50", "_tracked", "_.movDLC_x", ""))), (F.col("p_size") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", N.match_key(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), tail)).alias("match_key"))


@register("matched_sessions", """WITH v AS (SELECT c_custkey, lower(c_name) AS k FROM customer), p AS (SELECT s_suppkey, lower(replace(s_name, 'Supplier', 'Customer')) AS k FROM supplier), l AS (SELECT k, max(s_suppkey) AS pose FROM p GROUP BY k) SELECT c_custkey, pose FROM v JOIN l USING (k)""")
def matched_sessions(spark, d):
    """Videos to poses by key; of several poses of a key the last."""
    v = table(spark, d, "customer").select("c_custkey", N.match_key(F.col("c_name")).alias("k"))
    p = table(spark, d, "supplier").select("s_suppkey", N.match_key(F.replace("s_name", F.lit("Supplier"), F.lit("Customer"))).alias("k"))
    return v.join(p.groupBy("k").agg(F.max("s_suppkey").alias("pose")), "k").select("c_custkey", "pose")


_SEGMENT = "CASE WHEN user_id % 5 = 0 THEN 'seg_' || event_id || '_' || user_id ELSE 'seg_a' || user_id % 3 || '_session_' || user_id || '_' || event_id || '_' || event_id + 15 END"


@register("parsed_segment_ids", f"""WITH s AS (SELECT event_id, {_SEGMENT} AS id FROM events) SELECT event_id, nullif(regexp_extract(id, '_(\\d+)_(\\d+)$', 1), '')::BIGINT AS start_frame, nullif(regexp_extract(id, '_(\\d+)_(\\d+)$', 2), '')::BIGINT AS end_frame, 'session_' || nullif(regexp_extract(id, '_session_([^_]+)_', 1), '') AS session FROM s""")
def parsed_segment_ids(spark, d):
    u, e = F.col("user_id"), F.col("event_id")
    seg = F.when(u % 5 == 0, F.concat(F.lit("seg_"), e, F.lit("_"), u)).otherwise(F.concat(F.lit("seg_a"), u % 3, F.lit("_session_"), u, F.lit("_"), e, F.lit("_"), e + 15))
    start, end = N.segment_frames(seg)
    return table(spark, d, "events").select("event_id", start.alias("start_frame"), end.alias("end_frame"), N.segment_interval(seg)[0].alias("session"))


@register("subject_names", "SELECT p_partkey, nullif(trim(regexp_extract(p_name, '^([a-z]+)', 1)), '') AS subject, nullif(trim(regexp_extract(p_type, '(BRASS|STEEL|[A-Z]+)$', 1)), '') AS session_type FROM part")
def subject_names(spark, d):
    return table(spark, d, "part").select("p_partkey", N.extract_name(F.col("p_name"), "^([a-z]+)").alias("subject"), N.extract_name(F.col("p_type"), "(BRASS|STEEL|[A-Z]+)$").alias("session_type"))
