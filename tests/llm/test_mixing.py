from collections import defaultdict

from ethospark.llm import mixing


def reshare(sizes):
    """Targets by the plain loop: give by weight, stop what is above, give its excess again."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(names)}
    total, cap = 1.5 * sum(sizes.values()), {s: 2.0 * n for s, n in sizes.items()}
    stopped = set()
    while True:
        left, free = total - sum(cap[s] for s in stopped), [s for s in names if s not in stopped]
        t = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if t[s] > cap[s]}
        if not over:
            return t | {s: cap[s] for s in stopped}
        stopped |= over


ROWS = [(i, " ".join(["w"] * (i * 7 % 30)), f"s{i % 5 if i % 3 else 0}") for i in range(200)] + [(200, None, "s1"), (201, "", None), (202, "a\tb\x0bc", None), (203, "x y", "é"), (7, "w w w", "s1"), (7, "w w w", "s1"), (None, "q q", "s2")]


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, quality int")
    got = mixing.mix(docs, labels).collect()
    assert len(got) == len(ROWS)
    size, taken, target = defaultdict(int), defaultdict(int), {}
    for r in got:
        size[r.source] += r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = reshare(size)
    for s in size:
        assert abs(target[s] - want[s]) < 1e-6 and abs(taken[s] - target[s]) <= 1
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, labels).collect()))


def test_words(spark):
    got = {r.doc_id: r.size for r in mixing.mix(spark.createDataFrame([(202, "a\tb\x0bc", None), (203, "x y", "é"), (1, None, "a")], "doc_id long, text string, source string")).collect()}
    assert got == {202: 3, 203: 1, 1: 0}


def test_clashing_columns_and_texts_without_words(spark):
    """Whatever other columns are called, they come back; a document without words is in the mix once."""
    names = ["end", "target", "rest", "epochs", "before", "source_size", "size", "key", "s", "w", "cap", "quality", "a.b"]
    docs = spark.createDataFrame(ROWS + [(300, " \t", "s0"), (301, None, "s0"), (302, "", "only")], "doc_id long, text string, source string").withColumns({c: mixing.F.lit(c) for c in names})
    out = mixing.mixed_documents(docs, spark.createDataFrame([(1, 1)], "doc_id long, quality int"))
    assert out.columns == docs.columns
    rows = out.collect()
    assert all(r["end"] == "end" and r["a.b"] == "a.b" for r in rows)
    times = {}
    for r in rows:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(times[i] == 1 for i in (200, 201, 300, 301, 302))
    assert mixing.mixed_documents(docs.limit(0)).collect() == []


def test_bucket_count_changes_nothing(spark, monkeypatch):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    one = sorted(map(str, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BUCKETS", 3)
    assert one == sorted(map(str, mixing.mix(docs).collect()))


def test_documents_and_empty(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string").withColumn("size", mixing.F.lit(1))
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    n = sum(len((r.text or "").split()) for r in out.collect())
    whole = sum(len((t or "").split()) for _, t, _ in ROWS)
    assert abs(n - 1.5 * whole) < 0.1 * whole
    assert mixing.mix(docs.limit(0)).collect() == []
