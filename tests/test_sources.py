"""Pose files, session tables, names and regions on small files and by hand."""

import json
import math

import pytest

from ethospark.functions import geometry as G, names as N
from ethospark.sources import poses as P, tables as T

THREE = "scorer,net,net,net,net,net,net\nbodyparts,LeftEar,LeftEar,LeftEar,spine1,spine1,spine1\ncoords,x,y,likelihood,x,y,likelihood\n0,1.5,2.5,0.9,3,4,0.8\n1,2.5,,0.1,5,6,0.7\n"
FOUR = "scorer,n,n,n,n,n,n\nindividuals,m1,m1,m1,m2,m2,m2\nbodyparts,nose,nose,nose,nose,nose,nose\ncoords,x,y,likelihood,x,y,likelihood\n0,1,2,0.9,3,4,0.8\n1,5,6,0.5,7,8,0.4\n2,9,10,1,11,12,1\n"


def test_headers_of_three_and_four_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(THREE)
    (tmp_path / "b.csv").write_text(FOUR)
    got = {(r.animal, r.frame, r.bodypart): (r.x, r.y, r.likelihood) for r in P.load(spark, str(tmp_path / "a.csv")).collect()}
    assert got == {("individual0", 0, "left_ear"): (1.5, 2.5, 0.9), ("individual0", 0, "spine_1"): (3.0, 4.0, 0.8), ("individual0", 1, "left_ear"): (2.5, None, 0.1), ("individual0", 1, "spine_1"): (5.0, 6.0, 0.7)}
    got = {(r.animal, r.frame): (r.x, r.y) for r in P.load(spark, str(tmp_path / "b.csv"), {"nose": "snout"}).where("bodypart = 'snout'").collect()}
    assert got == {("m1", 0): (1, 2), ("m2", 0): (3, 4), ("m1", 1): (5, 6), ("m2", 1): (7, 8), ("m1", 2): (9, 10), ("m2", 2): (11, 12)}
    assert P.probe(spark, str(tmp_path / "a.csv")) == {"body_parts": ["left_ear", "spine_1"], "individuals": [], "n_frames": 2}
    assert P.probe(spark, str(tmp_path / "b.csv")) == {"body_parts": ["nose"], "individuals": ["m1", "m2"], "n_frames": 3}
    _, columns = P.header(FOUR.splitlines())
    assert P.first_animal(P.load(spark, str(tmp_path / "b.csv")), columns).count() == 3
    wide = P.widen(P.load(spark, str(tmp_path / "b.csv")), ["animal"], ["nose"]).where("animal = 'm1' and frame = 1").first()
    assert (wide.nose_x, wide.nose_y, wide.nose_likelihood) == (5.0, 6.0, 0.5)
    with pytest.raises(ValueError):
        P.load(spark, "x.txt")
    with pytest.raises(ValueError):
        P.header(["a,b", "0,1"])


def test_later_column_wins_after_renaming(spark, tmp_path):
    (tmp_path / "c.csv").write_text("s,a,a,a,b,b,b\nbodyparts,LeftEar,LeftEar,LeftEar,left_ear,left_ear,left_ear\ncoords,x,y,likelihood,x,y,likelihood\n0,1,1,1,2,2,2\n")
    assert [r.x for r in P.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [2.0]


def test_part_names(spark):
    cases = {"LeftEar": "left_ear", "leftear": "left_ear", "left_ear": "left_ear", "TailBase": "tail_base", "spine1": "spine_1", "fore-paw L": "fore_paw_l", "tailtipx": "tail_tip_x", "zzz": "zzz"}
    assert {k: N.part_name(k) for k in cases} == cases
    df = spark.createDataFrame([(k,) for k in cases], "n string")
    from pyspark.sql import functions as F

    assert {r.n: r.p for r in df.select("n", N.part_name_column(F.col("n")).alias("p")).collect()} == cases
    assert N.suggest_parts(["nose", "center_body", "left_ear", "hip"], ["snout", "back_mid", "earLeft", "zz"]) == {"nose": "snout", "center_body": "back_mid", "left_ear": "earLeft", "hip": ""}
    assert N.rename_parts(["a", "b"], {"a": "c", "b": "a", "c": "", "x": "y"}) == {"a": "c", "b": "a"}
    assert N.rename_tokens(["dist_nose_to_ear_left", "earleft"], {"ear_left": "left_ear"}) == {"dist_nose_to_ear_left": "dist_nose_to_left_ear"}


def test_feature_names():
    assert N.distance_name("dist_nose_to_left_ear_norm_mean") == "dist_left_ear_to_nose_norm_mean" and N.distance_name("dist_a_to_b_to_c") == "dist_a_to_b_to_c" and N.distance_name("nose_to_target_dist") == "nose_to_target_dist"
    assert [N.family(c) for c in ("social_approach_velocity", "flow_mag_near_roi_2", "nose_to_roi_2_dist", "nose_speed_mean", "heroic_turn", "occupied")] == ["social", "video", "context", "kinematics", "pose", "context"]
    cols = ["turn", "speed", "roi1", "flow_a", "r3d_1", "social_x"]
    assert N.select_features(cols, video=True, context=True, social=True) == ["turn", "speed", "roi1", "flow_a", "r3d_1", "social_x"]
    assert N.select_features(cols, video=True, embeddings=False) == ["turn", "speed", "flow_a"]
    assert N.target_class({0: "no_behavior", 1: "uuid"}, "Dig") == 1 and N.target_class({0: "dig!", 1: "run"}, "Dig") == 0 and N.target_class({0: "a", 1: "b"}, "c") is None
    assert N.excluded(["a_speed", "b", "c"], ["c"], ["speed"]) == {"a_speed", "c"}
    names = N.sheet_names(["a/b", "A_b", "", "x" * 40, "x" * 40])
    assert names == ["a_b", "A_b_2", "subject", "x" * 31, "x" * 29 + "_2"]


def test_session_tables(spark, tmp_path):
    a = spark.createDataFrame([(1, "s1", 1.0, float("nan")), (2, "s1", None, float("inf"))], "segment_id long, session string, u double, v double")
    b = spark.createDataFrame([(2, "s1", 9.0, 1), (3, "s2", 3.0, 1)], "segment_id long, session string, u double, w int")
    assert {(r.segment_id, r.u) for r in T.pool([a, b], "segment_id").collect()} == {(1, 1.0), (2, None), (3, 3.0)}
    assert [(r.u, r.v) for r in T.zero_missing(a, ["u", "v"]).orderBy("segment_id").collect()] == [(1.0, 0.0), (0.0, 0.0)]
    f = T.federate({"p": a, "q": b}, "session")
    assert f.columns == ["segment_id", "session", "u", "v", "w"] and {r.session for r in f.collect()} == {"p:s1", "q:s1", "q:s2"}
    assert T.numeric(a) == ["u", "v"] and T.informative(b.withColumn("k", b.u * 0), ["u", "k"]) == ["u"]
    path = str(tmp_path / "t")
    T.write_sessions(a, path, "session")
    T.write_sessions(spark.createDataFrame([(7, "s9", 1.0, 1.0)], a.schema), path, "session")
    assert T.n_rows(spark, path) == 3 and set(T.columns(spark, path)) == {"segment_id", "session", "u", "v"}
    T.write_json(spark, str(tmp_path / "m.json"), {"b": 1})
    T.write_json(spark, str(tmp_path / "m.json"), {"b": 2})
    assert json.loads((tmp_path / "m.json").read_text()) == {"b": 2}
    assert T.missing_files(spark, [("video", str(tmp_path / "m.json")), ("pose", str(tmp_path / "no"))]) == {"pose": [str(tmp_path / "no")]}
    T.write_report(b, str(tmp_path / "run" / "cells.csv"), ["segment_id"])
    assert [r.segment_id for r in T.read_run(spark, str(tmp_path / "run"))["cells"].collect()] == [2, 3]
    T.copy_tree(spark, str(tmp_path / "run"), str(tmp_path / "bundle"))
    assert (tmp_path / "bundle" / "cells.csv").exists()
    assert T.capped(spark.range(100).selectExpr("id", "id % 4 as s"), "s", "id", 20, "1").groupBy("s").count().where("count <> 5").count() == 0


def test_aligned_columns(spark):
    df = spark.createDataFrame([(1.0, None, 3.0)], "dist_a_to_b_mean double, dist_d_to_c double, dist_c_to_d double")
    m = T.merge_spellings(df)
    assert m.columns == ["dist_a_to_b_mean", "dist_c_to_d"] and m.first()[1] == 3.0
    r = T.align(m, ["dist_b_to_a_mean", "dist_d_to_c", "dist_c_to_d", "gone"]).first()
    assert (r[0], r[1], r[2], r[3]) == (1.0, None, 3.0, 0.0)


def test_regions_by_hand():
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert G.cut_corners([(0, 0), (4, 0), (4, 4)], 1) == [(1.0, 0.0), (3.0, 0.0), (4.0, 1.0), (4.0, 3.0), (3.0, 3.0), (1.0, 1.0)]
    dense = [(float(i), 0.0) for i in range(10)] + [(10.0, float(i)) for i in range(10)] + [(10.0 - i, 10.0) for i in range(10)] + [(0.0, 10.0 - i) for i in range(10)]
    assert sorted(G.simplify(dense, 0.5)) == sorted(square) and G.simplify(square[:3], 9) == square[:3]
    (cx, cy), long, short, half, wide = G.roi_axes({"shape": "polygon", "points": [(0, 0), (8, 8), (9, 7), (1, -1)]})
    assert abs(abs(long[0]) - math.sqrt(0.5)) < 1e-9 and abs(long[0] * short[0] + long[1] * short[1]) < 1e-12 and half > wide
    assert G.scale_roi({"shape": "rect", "x": 3, "y": 5, "w": 1, "h": 9}, 0.5) == {"shape": "rect", "x": 1, "y": 2, "w": 1, "h": 4}
    assert G.scale_roi({"shape": "circle", "cx": 2.0, "cy": 4.0, "r": 3.0}, 0.5)["r"] == 1.5
