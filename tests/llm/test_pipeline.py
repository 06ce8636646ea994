"""The corpus pipeline on a small planted table."""

import random
import zlib

import corpus_pipeline
from pyspark.sql import functions as F

from ethospark.llm import decontaminate, neardup
from ethospark.llm.common import materialize


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=6)) for _ in range(n))


def test_pipeline_drops_copies_and_leaks_and_mixes_the_rest(spark, tmp_path):
    """One of a group of copies stays, a document with a benchmark item goes, the rest is mixed.

    Two sources of equal size weigh 3 and 1 and share 150 %: the first stops at twice its size, the second keeps the rest, once its size.
    """
    item = prose("item", 60)
    docs = [(i, prose(i, 100), "en", "ab"[i % 2], 0) for i in range(20)]
    docs += [(20, prose(0, 100), "en", "a", 0), (21, f"{prose('x', 20)} {item} {prose('y', 20)}", "en", "b", 0)]
    tables = {
        "documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"),
        "labels": ([], "doc_id long, quality int, toxic int"),
        "benchmark": ([(1, item), (2, prose("other", 60))], "item_id long, text string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    times = {}
    for r in out:
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert 21 not in times
    assert (0 in times) != (20 in times)
    kept = set(times) - {0, 20}
    assert kept == set(range(1, 20))
    assert all(times[i] == (1 if i % 2 else 2) for i in kept)
    assert sorted(r["slot"] for r in out if r["shard"] == out[0]["shard"])[0] == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near-dedup", "decontamination", "mixing", "sharding"]


def write(spark, folder, docs, extra=(), labels=(), benchmark=()):
    tables = {"documents": (docs, "doc_id long, text string, lang string, source string, n_chars long"), "labels": (list(labels), "doc_id long, quality int, toxic int"), "benchmark": (list(benchmark), "item_id long, text string")}
    for name, (rows, schema) in tables.items():
        df = spark.createDataFrame(rows, schema)
        if name == "documents":
            df = df.withColumns({c: F.lit(c) for c in extra})
        df.write.parquet(str(folder / f"{name}.parquet"))
    return str(folder)


#: Names that the stages use themselves.
CLASHING = ["shard", "slot", "toxicity", "score", "target", "end", "rest", "epochs", "class_id", "id", "key", "comp", "th", "md", "size", "f", "r", "a.b"]


def test_pipeline_on_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and repeated rows, ties, a very long text, clashing columns and a toxic document."""
    docs, labels = [], []
    for i in range(400):
        bad = i % 8 == 0
        docs.append((i, ". ".join(f"{'zqxidiot ' if bad and k == 1 else ''}{prose(1000 * i + k, 9)}" for k in range(4)), "en", "ab"[i % 2], 1))
        if zlib.crc32(str(i).encode()) % 3 != 1:
            labels.append((i, None if i % 5 else 1, int(bad)))
    odd = [(1000, None, None, None, None), (1001, "", "en", "a", 0), (None, prose("none", 30), "en", None, 5), (None, None, None, None, None), (1002, "word " * 30_000, "en", "b", 9), (1003, docs[1][1], "en", "b", 1), (3, docs[3][1], "en", "b", 1), (1004, " \n ", "en", "b", 1)]
    folder = write(spark, tmp_path, docs + odd, CLASHING, [*labels, (None, 1, 1), (5, 0, None)], [(1, prose("item", 40)), (None, "x"), (2, None), (3, "")])
    stage = spark.read.parquet(f"{folder}/documents.parquet")
    columns = stage.columns
    left = {}
    for name, run in corpus_pipeline.STAGES:
        stage = materialize(run(spark, stage, folder), "test-stage")
        if name != "sharding":
            assert stage.columns == columns
            left[name] = [r.doc_id for r in stage.select("doc_id").collect()]
    toxic = {i for i in range(400) if i % 8 == 0}
    gone = set(range(400)) - set(left["toxicity"])
    assert len(gone & toxic) > 0.9 * len(toxic) and not gone - toxic
    assert len([i for i in left["toxicity"] if i is None or i >= 1000]) == 8 - 1 and left["toxicity"].count(3) == 2
    assert left["near-dedup"].count(3) == 1 and 1003 not in left["near-dedup"] and 1 in left["near-dedup"]
    assert {1000, 1001, 1002, 1004} <= set(left["near-dedup"]) | {1001, 1004} and left["near-dedup"].count(None) == 2
    assert sorted(map(str, left["decontamination"])) == sorted(map(str, left["near-dedup"]))
    assert {1000, 1002} <= set(left["mixing"]) and left["mixing"].count(1000) == 1
    out = stage.collect()
    assert len(out) == len(left["mixing"]) and set(r.law for r in out) == {"rows"}
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1


def test_pipeline_on_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, write(spark, tmp_path, [])).collect() == []


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Without labels of toxicity: classes by all pairs, leaks by full alignment; what is left of one source comes once and a half of its words."""
    rng = random.Random(31)
    words = [prose(k, 1) for k in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(30)) for k in range(3)]
    docs = [(i, text(80)) for i in range(40)]
    for k in range(30):
        w = docs[k % 10][1].split()
        for at in range(k % 4):
            w[7 + 20 * at] = "changed"
        docs.append((100 + k, " ".join(w)))
    docs += [(200 + k, f"{text(20)} {items[k][1]} {text(20)}") for k in range(3)]
    folder = write(spark, tmp_path, [(i, t, "en", "a", 1) for i, t in docs], (), [], items)
    known = neardup._Words()
    sets = {i: neardup.shingles(t, known) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD:
                x, y = sorted((root(a), root(b)))
                up[y] = x
    leak = lambda t: any(decontaminate.align(decontaminate.words(t), decontaminate.words(x))[0] >= decontaminate.THRESHOLD for _, x in items)
    kept = {i: t for i, t in docs if root(i) == i and not leak(t)}
    out = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
    assert set(out) == set(kept) and not set(out) & {200, 201, 202}
    n = sum(len(kept[i].split()) for i in out)
    whole = sum(len(t.split()) for t in kept.values())
    assert abs(n - 1.5 * whole) <= max(len(t.split()) for t in kept.values())
