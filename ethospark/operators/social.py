"""Features of two animals in one frame, their contact, summaries, dominance and identity swaps. Tables as in `kinematics`, with `animal`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import kinematics as K

#: Contact is a nearest pair of parts within this share of the body length.
CONTACT = 0.5
DISTANCES = ("dist_centroid_to_centroid", "dist_nose_to_nose", "dist_nose_to_tail_base", "min_keypoint_dist")
DIRECTIONS = ("facing_angle", "other_facing_focal", "approach_velocity", "bbox_overlap", "heading_alignment", "radial_velocity_toward")


def _box(parts: list[str]) -> dict[str, Column]:
    return {"x0": F.least(*map(K.x, parts)), "x1": F.greatest(*map(K.x, parts)), "y0": F.least(*map(K.y, parts)), "y1": F.greatest(*map(K.y, parts))}


def dyads(df: DataFrame, session: str, parts: list[str], fps: float) -> DataFrame:
    """One row a (session, animal, frame, other): the ten dyadic features and the focal animal's body length.

    Animals meet by (session, frame), so a join key holds no more rows than a session has animals.
    """
    w = Window.partitionBy(session, "animal").orderBy("frame")
    nose, tail = K.find(parts, K.NOSE), K.find(parts, K.TAIL)
    cx, cy = K.centroid(parts)
    own = df.withColumns({"cx": cx, "cy": cy, "axis": K.body_axis(parts), "body_length": K.body_length(parts)} | _box(parts))
    own = own.withColumns({"cvx": K.change(F.col("cx"), w, fps), "cvy": K.change(F.col("cy"), w, fps)})
    place = F.array(*(F.struct(K.x(p).alias("x"), K.y(p).alias("y")) for p in parts))
    own = own.select(session, "animal", "frame", "cx", "cy", "cvx", "cvy", "axis", "body_length", "x0", "x1", "y0", "y1", place.alias("place"), K.x(nose).alias("nx"), K.y(nose).alias("ny"), K.x(tail).alias("tx"), K.y(tail).alias("ty"))
    other = own.select(session, "frame", F.col("animal").alias("other"), *(F.col(c).alias(f"o_{c}") for c in own.columns if c not in (session, "frame", "animal")))
    j = own.join(other, [session, "frame"]).where(F.col("animal") != F.col("other"))
    dx, dy = F.col("o_cx") - F.col("cx"), F.col("o_cy") - F.col("cy")
    d = F.hypot(dx, dy)
    nearest = F.array_min(F.flatten(F.transform("place", lambda a: F.transform("o_place", lambda b: F.hypot(a["x"] - b["x"], a["y"] - b["y"])))))
    wide, high = F.greatest(F.lit(0.0), F.least("x1", "o_x1") - F.greatest("x0", "o_x0")), F.greatest(F.lit(0.0), F.least("y1", "o_y1") - F.greatest("y0", "o_y0"))
    area = lambda p: (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))
    union = area("") + area("o_") - wide * high
    j = j.select(
        session, "animal", "frame", "other", "body_length", d.alias("dist_centroid_to_centroid"), F.hypot(F.col("nx") - F.col("o_nx"), F.col("ny") - F.col("o_ny")).alias("dist_nose_to_nose"), F.hypot(F.col("nx") - F.col("o_tx"), F.col("ny") - F.col("o_ty")).alias("dist_nose_to_tail_base"), nearest.alias("min_keypoint_dist"),
        F.abs(K.wrap(F.atan2(dy, dx) - F.col("axis"))).alias("facing_angle"), F.abs(K.wrap(F.atan2(-dy, -dx) - F.col("o_axis"))).alias("other_facing_focal"), F.when(union > 0, wide * high / union).alias("bbox_overlap"), F.cos(K.wrap(F.col("axis") - F.col("o_axis"))).alias("heading_alignment"),
        F.when(d > 1e-6, (F.col("cvx") * dx + F.col("cvy") * dy) / d).alias("radial_velocity_toward"),
    )
    pair = Window.partitionBy(session, "animal", "other").orderBy("frame")
    return j.withColumn("approach_velocity", -K.change(F.col("dist_centroid_to_centroid"), pair, fps))


def social_features(df: DataFrame, session: str, parts: list[str], fps: float) -> DataFrame:
    """social_<base>_nearest (of the animal of least centroid distance, the first of equals) and _mean, over the body length for distances; contact and its duration."""
    j = dyads(df, session, parts, fps)
    bases = DISTANCES + DIRECTIONS
    g = j.groupBy(session, "animal", "frame").agg(F.first("body_length").alias("bl"), F.min_by(F.struct(*bases), F.struct("dist_centroid_to_centroid", "other")).alias("near"), *(F.avg(b).alias(f"social_{b}_mean") for b in bases))
    out = g.withColumns({f"social_{b}_nearest": F.col(f"near.{b}") for b in bases}).withColumn("bl", F.when(F.col("bl") > 1e-3, F.col("bl")))
    out = out.withColumns({f"social_{b}_{k}_norm": F.col(f"social_{b}_{k}") / F.col("bl") for b in DISTANCES for k in ("nearest", "mean")})
    out = out.withColumn("social_in_contact", F.coalesce(F.col("social_min_keypoint_dist_nearest") <= CONTACT * F.col("bl"), F.lit(False)).cast("double"))
    w = Window.partitionBy(session, "animal").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0)
    first = F.row_number().over(Window.partitionBy(session, "animal").orderBy("frame")) - 1
    out = out.withColumn("__i", first).withColumn("__off", F.coalesce(F.max(F.when(F.col("social_in_contact") == 0, F.col("__i"))).over(w), F.lit(0)))
    return out.withColumn("social_in_contact_duration_s", F.when(F.col("social_in_contact") == 1, (F.col("__i") - F.col("__off")) / fps).otherwise(0.0)).drop("near", "bl", "__i", "__off")


def summary(df: DataFrame, keys: list[str], fps: float) -> DataFrame:
    """Per animal: means of what is known, contact time, share, bouts (rising edges) and mean bout, share of advancing frames among those that tell."""
    w = Window.partitionBy(*keys).orderBy("frame")
    on = F.coalesce(F.col("social_in_contact"), F.lit(0.0)) > 0.5
    rise = on & ~F.coalesce(F.lag(on).over(w), F.lit(False))
    near = lambda c: F.avg(f"social_{c}_nearest")
    g = df.withColumn("__rise", rise.cast("int")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_frames"), F.avg("social_dist_centroid_to_centroid_nearest_norm").alias("mean_distance_norm"), near("dist_centroid_to_centroid").alias("mean_distance_px"), (F.sum(on.cast("int")) / fps).alias("contact_time_s"), F.avg(on.cast("int")).alias("contact_fraction"), F.sum("__rise").alias("n_contact_bouts"),
        near("approach_velocity").alias("mean_approach_velocity"), near("radial_velocity_toward").alias("mean_radial_velocity_toward"), F.avg((F.col("social_radial_velocity_toward_nearest") > 0).cast("double")).alias("advance_fraction"), near("facing_angle").alias("mean_facing_angle"), near("heading_alignment").alias("mean_heading_alignment"),
    )
    return g.withColumn("mean_contact_bout_s", F.when(F.col("n_contact_bouts") > 0, F.col("contact_time_s") / F.col("n_contact_bouts")).otherwise(0.0))


def dominance(df: DataFrame, session: str, used: Column, fps: float) -> DataFrame:
    """Score = mean radial velocity less the share of retreating frames, over the frames `used` that tell; rank in the session, dominant if first of several."""
    r = F.when(used, F.col("social_radial_velocity_toward_nearest"))
    g = df.groupBy(session, "animal").agg((F.count(r) / fps).alias("interaction_time_s"), F.coalesce(F.avg(r), F.lit(0.0)).alias("mean_advance"), F.coalesce(F.avg((r < 0).cast("double")), F.lit(0.0)).alias("yield_fraction"), (F.avg(r) - F.avg((r < 0).cast("double"))).alias("dominance_score"))
    w = Window.partitionBy(session)
    g = g.withColumns({"dominance_rank": F.row_number().over(w.orderBy(F.desc_nulls_last("dominance_score"), "animal")), "__n": F.count(F.lit(1)).over(w)})
    return g.withColumn("is_dominant", (F.col("dominance_rank") == 1) & (F.col("__n") > 1)).drop("__n")


def interaction_states(profiles: DataFrame, distance: str, contact: str) -> DataFrame:
    """States whose mean distance is at most the median over states, or, where no distance is known, whose contact is at least it. profiles has a row a state."""
    m = profiles.agg(F.median(distance).alias("md"), F.median(contact).alias("mc"))
    near = F.when(F.col("md").isNotNull(), F.col(distance) <= F.col("md")).otherwise(F.col(contact) >= F.col("mc"))
    return profiles.join(F.broadcast(m)).where(near).drop("md", "mc")


def identity_swaps(df: DataFrame, session: str, parts: list[str]) -> DataFrame:
    """Frames at which a pair of animals moved less in all had they changed places, one by more than max(15, 4 * the session's median step): (session, a, b, frame)."""
    w = Window.partitionBy(session, "animal").orderBy("frame")
    cx, cy = K.centroid(parts)
    step = df.select(session, "animal", "frame", cx.alias("cx"), cy.alias("cy")).withColumns({"px": F.lag("cx").over(w), "py": F.lag("cy").over(w), "pf": F.lag("frame").over(w)}).where("px is not null and frame = pf + 1")
    step = step.withColumn("own", F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py")))
    limit = step.groupBy(session).agg(F.greatest(F.lit(15.0), 4 * F.median("own")).alias("limit"))
    a, b = (step.select(session, "frame", *(F.col(c).alias(f"{k}_{c}") for c in ("animal", "cx", "cy", "px", "py", "own"))) for k in "ab")
    j = a.join(b, [session, "frame"]).where("a_animal < b_animal").join(limit, session)
    crossed = F.hypot(F.col("a_cx") - F.col("b_px"), F.col("a_cy") - F.col("b_py")) + F.hypot(F.col("b_cx") - F.col("a_px"), F.col("b_cy") - F.col("a_py"))
    return j.where((crossed < F.col("a_own") + F.col("b_own")) & (F.greatest("a_own", "b_own") > F.col("limit"))).select(session, F.col("a_animal").alias("a"), F.col("b_animal").alias("b"), "frame")


def apply_swaps(df: DataFrame, session: str, swaps: DataFrame) -> DataFrame:
    """Rows with the animal they are once each swap (session, a, b, frame) holds from its frame on; later swaps compose with earlier ones.

    Swaps of a session become one array of steps, so frames are neither shuffled with them nor ordered: they are few corrections by hand.
    """
    steps = swaps.where("a <> b and frame > 0").groupBy(session).agg(F.array_sort(F.collect_list(F.struct("frame", "a", "b"))).alias("__s"))
    now = F.aggregate(F.filter("__s", lambda s: s["frame"] <= F.col("frame")), F.col("animal"), lambda who, s: F.when(who == s["a"], s["b"]).when(who == s["b"], s["a"]).otherwise(who))
    return df.join(steps, session, "left").withColumn("animal", F.when(F.col("__s").isNull(), F.col("animal")).otherwise(now)).drop("__s")
