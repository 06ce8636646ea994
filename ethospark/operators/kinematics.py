"""Framewise kinematics of wide pose tables: columns <part>_x, <part>_y and <part>_likelihood, one row a frame.

keys are the columns of an animal in a session; `frame` orders its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.names import part_name
from . import windows as W

#: Names a part goes by, best first.
NOSE, TAIL = ("nose", "snout", "head"), ("tail_base", "tailbase", "tail")
AXES = (("tailbase", "nose"), ("tail_base", "nose"), ("spine1", "nose"), ("body_center", "nose"), ("center", "nose"), ("centre", "nose"))
LENGTHS = ((NOSE, TAIL), (NOSE, ("tail_tip", "tail_end")), (NOSE, ("rump", "back")), (("spine1", "back"), TAIL[:2]))
#: Angle, and the names of its three parts; the angle is at the second.
_MIDDLE, _PAW_L, _PAW_R = ("body_center", "center_body", "body_mid", "back", "center", "spine1"), ("paw_left", "paw_l", "forepaw_left", "front_left", "frontleg_left"), ("paw_right", "paw_r", "forepaw_right", "front_right", "frontleg_right")
JOINTS = (
    ("spine_flexion", NOSE, ("body_center", "center_body", "back", "body_mid", "center", "spine2", "mid_back", "spine_mid"), TAIL), ("lateral_torso", ("body_left", "left_body"), ("body_mid", "center_body", "body_center", "center", "back"), ("body_right", "right_body")),
    ("head_neck_angle", NOSE[:2], ("neck", "ear_left", "left_ear"), _MIDDLE), ("forelimb_spread", ("frontleg_left", "front_leg_left", "forepaw_left", "front_left", "paw_l"), ("back", "body_center", "center_body", "center", "spine1", "shoulder"), ("frontleg_right", "front_leg_right", "forepaw_right", "front_right", "paw_r")),
    ("hindlimb_spread", ("backleg_left", "back_leg_left", "hindpaw_left", "hind_left"), ("tail_base", "tailbase", "rump", "back"), ("backleg_right", "back_leg_right", "hindpaw_right", "hind_right")), ("fore_limb_left", _PAW_L, ("elbow_left", "shoulder_left"), _MIDDLE), ("fore_limb_right", _PAW_R, ("elbow_right", "shoulder_right"), _MIDDLE),
    ("hind_limb_left", ("hind_paw_left", "hindpaw_left", "backleg_left", "back_leg_left"), ("knee_left", "hip_left"), TAIL[:2]), ("hind_limb_right", ("hind_paw_right", "hindpaw_right", "backleg_right", "back_leg_right"), ("knee_right", "hip_right"), TAIL[:2]),
)


def x(part: str) -> Column:
    return F.col(f"{part}_x")


def y(part: str) -> Column:
    return F.col(f"{part}_y")


def find(parts: list[str], names: tuple[str, ...]) -> str | None:
    """The part that goes by one of names: equal once spelled alike, else one whose words hold all of a name's."""
    by = {part_name(p): p for p in parts}
    for n in names:
        if part_name(n) in by:
            return by[part_name(n)]
    for n in names:
        for spelled, p in by.items():
            if set(part_name(n).split("_")) <= set(spelled.split("_")):
                return p
    return None


def axis_pair(parts: list[str]) -> tuple[str, str] | None:
    """(tail, head) of the body axis."""
    by = {part_name(p): p for p in parts}
    return next(((by[part_name(a)], by[part_name(b)]) for a, b in AXES if part_name(a) in by and part_name(b) in by), None)


def length_pair(parts: list[str]) -> tuple[str, str] | None:
    for heads, tails in LENGTHS:
        a, b = find(parts, heads), find(parts, tails)
        if a and b and a != b:
            return a, b
    return None


def distance(a: str, b: str) -> Column:
    return F.hypot(x(a) - x(b), y(a) - y(b))


def wrap(a: Column) -> Column:
    return F.atan2(F.sin(a), F.cos(a))


def body_axis(parts: list[str]) -> Column:
    """Angle from tail to head; 0 where the parts lack."""
    pair = axis_pair(parts)
    return F.atan2(y(pair[1]) - y(pair[0]), x(pair[1]) - x(pair[0])) if pair else F.lit(0.0)


def body_length(parts: list[str]) -> Column:
    """Head to tail in pixels, null up to 1 pixel or where the parts lack."""
    pair = length_pair(parts)
    return F.when(distance(*pair) > 1.0, distance(*pair)) if pair else F.lit(None).cast("double")


def centroid(parts: list[str], threshold: float = 0.0) -> tuple[Column, Column]:
    """Mean place of the parts of at least threshold likelihood, of all parts where there is none."""

    def mean(at) -> Column:
        values = F.array(*map(at, parts))
        some = F.filter(values, lambda v: v.isNotNull())
        if threshold > 0:
            fine = F.filter(F.array(*(F.when(F.col(f"{p}_likelihood") >= threshold, at(p)) for p in parts)), lambda v: v.isNotNull())
            some = F.when(F.size(fine) > 0, fine).otherwise(some)
        return F.when(F.size(some) > 0, F.aggregate(some, F.lit(0.0), lambda s, v: s + v) / F.size(some))

    return mean(x), mean(y)


def change(col: Column, w, fps: float) -> Column:
    """Framewise difference a second; 0 at the first frame."""
    return F.when(F.row_number().over(w) == 1, F.lit(0.0)).otherwise((col - F.lag(col).over(w)) * fps)


def part_motion(df: DataFrame, keys: list[str], parts: list[str], fps: float) -> DataFrame:
    """Velocity, speed, acceleration, jerk and velocity along and across the body of each part."""
    w = Window.partitionBy(*keys).orderBy("frame")
    out = df.withColumn("__axis", body_axis(parts))
    out = out.withColumns({f"{p}_velocity_{c}": change(F.col(f"{p}_{c}"), w, fps) for p in parts for c in "xy"})
    vx, vy = (lambda p: F.col(f"{p}_velocity_x")), (lambda p: F.col(f"{p}_velocity_y"))
    out = out.withColumns({f"__a{c}_{p}": change(F.col(f"{p}_velocity_{c}"), w, fps) for p in parts for c in "xy"})
    out = out.withColumns({f"{p}_speed": F.sqrt(vx(p) * vx(p) + vy(p) * vy(p)) for p in parts} | {f"{p}_acceleration": F.sqrt(F.col(f"__ax_{p}") ** 2 + F.col(f"__ay_{p}") ** 2) for p in parts})
    out = out.withColumns({f"{p}_jerk": change(F.col(f"{p}_acceleration"), w, fps) for p in parts} | {f"{p}_forward_velocity": vx(p) * F.cos("__axis") + vy(p) * F.sin("__axis") for p in parts} | {f"{p}_lateral_velocity": vy(p) * F.cos("__axis") - vx(p) * F.sin("__axis") for p in parts})
    return out.drop("__axis", *(f"__a{c}_{p}" for p in parts for c in "xy"))


def pair_distances(df: DataFrame, parts: list[str]) -> DataFrame:
    """dist_a_to_b of all pairs, ends sorted, and over the body length, save of the pair that is the body length."""
    length, own = body_length(parts), set(length_pair(parts) or ())
    cols: dict[str, Column] = {"body_length_px": length}
    for i, a in enumerate(parts):
        for b in parts[i + 1 :]:
            name = "dist_" + "_to_".join(sorted((a, b)))
            cols[name] = distance(a, b)
            if {a, b} != own:
                cols[f"{name}_norm"] = distance(a, b) / F.when(length > 1e-3, length)
    return df.withColumns(cols)


def head_direction(df: DataFrame, keys: list[str], parts: list[str], fps: float) -> DataFrame:
    """Direction from between the ears (else along the body) to the nose, its change a second, and the nose's speed along and across it."""
    left, right, nose = (find(parts, n) for n in (("ear_left", "left_ear", "ear_l"), ("ear_right", "right_ear", "ear_r"), NOSE))
    w = Window.partitionBy(*keys).orderBy("frame")
    ears = left is not None and right is not None
    angle = F.atan2(y(nose) - (y(left) + y(right)) / 2, x(nose) - (x(left) + x(right)) / 2) if ears else body_axis(parts)
    out = df.withColumns({"head_direction_angle": angle} | ({"ear_spread": distance(left, right)} if ears else {}))
    turn = F.col("head_direction_angle") - F.lag("head_direction_angle").over(w)
    out = out.withColumns({"__vx": change(x(nose), w, fps), "__vy": change(y(nose), w, fps), "head_angular_velocity": F.coalesce(wrap(turn) * fps, F.lit(0.0))})
    a = F.col("head_direction_angle")
    return out.withColumns({"head_forward_speed": F.col("__vx") * F.cos(a) + F.col("__vy") * F.sin(a), "head_lateral_speed": F.col("__vy") * F.cos(a) - F.col("__vx") * F.sin(a)}).drop("__vx", "__vy")


def joint_angle(a: str, joint: str, b: str) -> Column:
    """Angle at joint between a and b; null where an arm has no length."""
    ax, ay, bx, by = x(a) - x(joint), y(a) - y(joint), x(b) - x(joint), y(b) - y(joint)
    size = F.hypot(ax, ay) * F.hypot(bx, by)
    return F.when(size > 1e-9, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ax * bx + ay * by) / size))))


def joint_angles(parts: list[str]) -> dict[str, Column]:
    """joint_angle_<name> of each of JOINTS whose three parts are there and differ."""
    out = {}
    for name, *three in JOINTS:
        found = [find(parts, names) for names in three]
        if all(found) and len(set(found)) == 3:
            out[f"joint_angle_{name}"] = joint_angle(*found)
    return out


def curvature(chain: list[str]) -> Column:
    """Mean absolute turn along a chain of parts."""
    ways = [F.atan2(y(b) - y(a), x(b) - x(a)) for a, b in zip(chain, chain[1:])]
    turns = [F.abs(wrap(b - a)) for a, b in zip(ways, ways[1:])]
    return sum(turns[1:], turns[0]) / len(turns) if turns else F.lit(0.0)


def oscillation(df: DataFrame, keys: list[str], speed: str, window: int, out: str) -> DataFrame:
    """Squared distance of speed from its mean over the session, and its zero-padded moving mean over `window` frames."""
    whole = Window.partitionBy(*keys)
    power = (F.col(speed) - F.avg(speed).over(whole)) ** 2
    # A box of even width reaches one frame further back than ahead.
    near = whole.orderBy("frame").rowsBetween(-(window // 2), (window - 1) // 2)
    return df.withColumn(f"{out}_oscillation_power", power).withColumn(f"{out}_oscillation_energy", F.sum(f"{out}_oscillation_power").over(near) / window)


def rhythm(df: DataFrame, keys: list[str], col: str, fps: float, window: int, out: str) -> DataFrame:
    """Peak autocorrelation at a positive lag and dominant frequency of col in a window centred at each frame.

    A window is an array column, so a session need not fit in a task's memory; Arrow batches of windows go through numpy.
    """
    half = max(1, window // 2)
    near = Window.partitionBy(*keys).orderBy("frame").rowsBetween(-half, half)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for arrays in batches:
            rows = []
            for a in arrays:
                v = np.asarray(a, float) - np.mean(a)
                power = float(v @ v)
                peak = 0.0
                if len(v) >= 4 and power / len(v) > 1e-9 and power > 1e-9:
                    peak = max(float(v[k:] @ v[:-k]) for k in range(1, len(v))) / power
                spectrum = np.abs(np.fft.rfft(v))[1:] if len(v) >= 8 else v[:0]
                rows.append((peak, float((spectrum.argmax() + 1) * fps / len(v)) if len(spectrum) else 0.0))
            yield pd.DataFrame(rows, columns=["peak", "frequency"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    found = F.pandas_udf(run, "peak double, frequency double")
    out_df = df.withColumn("__w", F.collect_list(col).over(near)).withColumn("__r", found("__w"))
    return out_df.withColumns({f"{out}_autocorr_peak": F.col("__r.peak"), f"{out}_frequency": F.col("__r.frequency")}).drop("__w", "__r")


def periodicity(windows: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Largest non-constant Fourier magnitude of each window, order by pos; 0 under 8 rows or for a variance of 1e-10 at most.

    No Python: a window is one array.
    """
    rows = windows.groupBy(*keys, "window").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col(col).cast("double").alias("x")))), lambda e: e["x"]).alias("__v"))
    return rows.select(*keys, "window", W.periodicity(F.col("__v")).alias(f"{col}_periodicity"))
