"""Streams over files in several batches against the same rows at once."""

from pyspark.sql import functions as F

from ethospark.streaming import series as R


def stream(spark, tmp_path, rows, schema, parts=3):
    folder = tmp_path / "in"
    n = -(-len(rows) // parts)
    for i in range(parts):
        spark.createDataFrame(rows[i * n : (i + 1) * n], schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name).collect()


def test_state_is_carried_over_batches(spark, tmp_path):
    rows = [("a", i, bool(i % 7), float(i)) for i in range(30)] + [("b", i, True, float(-i)) for i in range(15)]
    rows.sort(key=lambda r: r[1])
    s = stream(spark, tmp_path, rows, "s string, frame long, on boolean, v double")
    got = {(r.s, r.frame): round(r.contact_s * 30) for r in run(R.contact_seconds(s, ["s"], "on", 30.0), "contact")}
    assert got == {(k, i): ((i % 7 if on else 0) if k == "a" else i) for k, i, on, _ in rows}
    warm = {(r.s, r.frame): r.v for r in run(R.warm_up(s, ["s"], "v", 4), "warm")}
    assert warm == {(k, i): 0.0 if i < 4 else v for k, i, _, v in rows}
    wins = {(r.s, r.start_frame): (r.end_frame, r.mean, r.max) for r in run(R.row_windows(s, ["s"], "v", 8, 3), "wins")}
    want = {}
    for k, n, sign in (("a", 30, 1), ("b", 15, -1)):
        for a in range(0, n - 7, 3):
            v = [sign * float(i) for i in range(a, a + 8)]
            want[(k, a)] = (a + 7, sum(v) / 8, max(v))
    assert wins == want


def test_windows_sessions_and_repeats(spark, tmp_path):
    times = [0, 1, 2, 3, 9, 10, 30, 31, 60]
    rows = [(i, "a", t, float(t)) for i, t in enumerate(times)] + [(8, "a", 60, 60.0)]
    s = stream(spark, tmp_path, rows, "id long, k string, t long, v double", 2).withColumn("ts", F.timestamp_seconds(F.col("t") + 960))
    batch = spark.createDataFrame(rows, "id long, k string, t long, v double").withColumn("ts", F.timestamp_seconds(F.col("t") + 960))
    whole = {(r.start, r.mean, r.n) for r in R.hopping(batch, ["k"], "ts", "v", "4 seconds", "2 seconds", "5 seconds").collect()}
    got = {(r.start, r.mean, r.n) for r in run(R.hopping(s, ["k"], "ts", "v", "4 seconds", "2 seconds", "5 seconds"), "hop")}
    assert got and got <= whole and len(got) >= len({x for x in whole if x[1] <= 31})
    sessions = {(r["first"].second, r["last"].second, r.n) for r in run(R.gap_sessions(s, ["k"], "ts", "5 seconds", "5 seconds"), "gaps")}
    assert sessions == {(0, 3, 4), (9, 10, 2), (30, 31, 2)}
    assert sorted(r.id for r in run(R.once(s, "id", "ts", "100 seconds"), "once")) == list(range(9))


def test_sinks(spark, tmp_path):
    rows = [(1, "a", 1), (2, "b", 1), (1, "c", 2), (3, "d", 1), (2, "e", 5), (2, "f", 3)]
    s = stream(spark, tmp_path, rows, "id long, label string, seq long")
    out = str(tmp_path / "out")
    s.writeStream.foreachBatch(R.upsert_sink(out, "id", "seq")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    last = max(int(p.name.split("=")[1]) for p in (tmp_path / "out").iterdir() if p.name.startswith("version="))
    assert {(r.id, r.label) for r in spark.read.parquet(f"{out}/version={last}").collect()} == {(1, "c"), (2, "e"), (3, "d")}
    trained = []
    sink = R.retrain_sink(lambda df: R.label_fingerprint(df, ["id", "label"]), lambda df: trained.append(df.count()))
    a = spark.createDataFrame(rows[:3], "id long, label string, seq long")
    for i, df in enumerate([a, a.repartition(3), a.limit(2)]):
        sink(df, i)
    assert trained == [3, 2]
