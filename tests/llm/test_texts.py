"""Small tables with nulls, ties, repeats and empty texts against plain Python."""

import hashlib
import io
import random
import re
import struct
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from ethospark.llm import common, decontaminate, licenses, media, neardup, sharding, toxicity, urls, warc

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghilmnorstu") for _ in range(RNG.randint(3, 8))) for _ in range(900)]


def prose(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


# 1. WARC
PAGES = [(1, "http://a/x y", "é" * 600), (2, None, "é" * 600), (3, "http://b", "é" * 600), (3, "http://b", "é" * 600), (4, "u", None), (5, "u", ""), (6, "u", "short"), (7, "u", "short"), (None, "u", "z" * 2000), (-8, "u", "q" * 999), (-9, "u", "q" * 999)]


def test_warc(spark, tmp_path):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    table = warc.write(df)
    got = sorted((tuple(r) for r in warc.read(table).collect()), key=str)
    want = []
    for i, _, h in PAGES:
        raw = (h or "").encode()
        last = 3 if raw == ("é" * 600).encode() else None
        to = last if last is not None and i != last else None
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if to else "response", to))
    assert got == sorted(want, key=str)
    warc.export(table, str(tmp_path))
    n = 0
    for p in tmp_path.iterdir():
        raw = p.read_bytes()
        magic, size = struct.unpack_from("<II", raw)
        assert magic == 0x184D2A5D
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw[8 : 8 + size]))
        n += d.stream_reader(io.BytesIO(raw[8 + size :]), read_across_frames=True).read().count(b"WARC/1.1\r\n")
    assert n == len(PAGES)
    assert warc.read(warc.write(df.limit(0))).collect() == []


def test_warc_rolls_over_and_finds_damage(monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    records = [warc.record(i, "u", prose(200).encode(), hashlib.sha1(b"").hexdigest(), None) for i in range(50)]
    found = list(warc.archives(iter(records)))
    assert len(found) > 3 and [x for a in found for x in warc.read_archive(a)] == records
    with pytest.raises(ValueError):
        warc.parse(records[0])


# 2. URL filters
def test_urls(spark):
    cases = [
        ("http://EXAMPLE.com/en/x", "example.com", "/en/x", "example.com/en/", "block"), ("https://www.example.com/en/?q", "www.example.com", "/en/", "www.example.com/en/", "allow"), ("http://a.com", "a.com", "", None, "allow"), ("http://a.com/", "a.com", "/", "com/", "allow"),
        ("x://b.net/es/1#f", "b.net", "/es/1", "net/es/", "block"), ("http://bnet/es/", "bnet", "/es/", None, "allow"), ("http://net/fr/", "net", "/fr/", "net/fr/", "block"), ("nothing", "", "", None, "allow"), (None, "", "", None, "allow"), ("h://É.com?x", "É.com", "", None, "allow"), ("h://a.org\n/p", "a.org\n", "/p", None, "allow"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "page_id long, url string").withColumn("host", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: tuple(r)[1:5] for r in urls.judge(df, none).collect()}
    assert got == {i: c[1:] for i, c in enumerate(cases)}


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        bad_host = rng.random() < 0.3
        url = f"http://{'spam' if bad_host else 'fine' + str(rng.randrange(3))}.org/{rng.choice('ab')}/{rng.choice(['buy', 'read'])}/{i}"
        rows.append((i, url, int("spam" in url and "buy" in url and rng.random() < 0.95)))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows if i % 4], "doc_id long, quality int, toxic int")
    rows += [(500, "http://spam.org/a/buy/9", None), (501, None, None), (502, "http://spam.org/a/buy/9", None)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string").withColumn("fired", F.lit("clash"))
    out = urls.judge(pages, labels).collect()
    items = {r.page_id: frozenset(r.t or ()) for r in pages.select("page_id", urls.tokens(F.col("url")).alias("t")).collect()}
    bad = {i: t for i, _, t in rows if t is not None and i % 4}
    taught = [(items[i], bad[n]) for i, u, _ in rows if u and (n := int(u.rsplit("/", 1)[1])) in bad]
    everywhere = frozenset.intersection(*(x for x, _ in taught))
    share = [sum(t == v for _, t in taught) / len(taught) for v in (0, 1)]
    least = max(urls.MIN_COUNT, urls.MIN_SUPPORT * len(taught))
    from itertools import combinations

    def best(own):
        found = [(0, 0, "", "allow")]
        for n in range(1, len(own) + 1):
            for part in map(frozenset, combinations(sorted(own - everywhere), n)):
                hit = [t for x, t in taught if part <= x]
                for v, name in enumerate(("allow", "block")):
                    k = hit.count(v)
                    if k >= least and k / len(hit) >= max(urls.MIN_CONFIDENCE, urls.MIN_LIFT * share[v]):
                        found.append((round(k / len(hit), 9), k, "", name))
        return max(found)

    want = {i: best(x) for i, x in items.items()}
    assert {r.page_id: (r.verdict, round(r.confidence or 0, 9)) for r in out} == {i: (w[3], w[0]) for i, w in want.items()}
    assert {w[3] for w in want.values()} == {"allow", "block"} and sum(r.fired is not None for r in out) > 100
    assert urls.judge(pages.limit(0), labels).collect() == []


def test_document_of_url(spark):
    cases = {"http://a.org/en/7817?utm=1": 7817, "https://b.net/en/4033.html": 4033, "http://c.com/en/1837/": 1837, "http://c.com/12/en": None, "http://c.com/en/x12": None, "http://c.com?5": None, "c.com/5": None, None: None, "h://c/a/3/44": 44}
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.n for r in df.select("url", urls.document_of(F.col("url")).alias("n")).collect()} == cases


def test_tokens_that_always_occur_together_are_one(spark):
    """30 path words in every bad url would make 2 ** 30 itemsets."""
    rows = [(i, f"http://x.org/{'/'.join(f'w{chr(97 + k % 26)}{k // 26}' for k in range(30)) if i % 2 else 'plain'}/{i}") for i in range(120)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    assert {(r.page_id % 2, r.verdict) for r in urls.judge(pages, labels).collect()} == {(0, "allow"), (1, "block")}


# 3. Licences
#: Notices that are no template, as they stand in files.
NOTICES = (
    ("gpl", "This code is licensed under GPLv3"), ("bsd", "SPDX-License-Identifier: BSD-3-Clause"), ("proprietary", "Copyright (c) 2021 Mary Major. All rights reserved."), ("mit", "Released under the terms of the MIT license, see LICENSE for details"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights"),
    ("gpl", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation; either version 2 of the License, or"),
    ("apache", "Licensed to the Foundation under one or more agreements. Licensed under the Apache License, Version 2.0 (the \"License\")"), ("apache", "This library is distributed under the Apache License 2.0"), ("mpl", "This file is subject to the terms of the Mozilla Public License, v. 2.0. If a copy was not distributed"),
    ("lgpl", "it is released under the GNU Lesser General Public License, version 2.1 or any later one"), ("cc-by-sa", "Text is available under the Creative Commons Attribution-ShareAlike 4.0 International License; additional terms may apply"), ("bsd", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file. Licensed under the BSD license"),
    ("agpl", "This server is licensed under the GNU Affero General Public License, version 3"), ("cc-by-nc", "Images are licensed under CC BY-NC 4.0"), ("proprietary", "Copyright 2018 Acme Corp. All rights reserved. Do not copy."),
)


def test_licenses(spark):
    rows = [(i, "\n\n".join([prose(12), prose(9)])) for i in range(60)] + [(100, prose(5) + "\n\nReleased under the MIT License.\n\n" + prose(9)), (101, "Licensed under the Apache License, Version 2.0"), (102, "licensed under cc by-nc 4.0"), (103, None), (104, ""), (None, "All rights reserved."), (105, "The license plate was lost"), (106, "\n\n"), (107, "All rights reserved."), (107, "All rights reserved.")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("family", F.lit(0)).withColumn("paragraph", F.lit(0))
    got = sorted(((r.doc_id, r.paragraph, r.family) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(100, 1, "mit"), (101, 0, "apache"), (102, 0, "cc-by-nc"), (None, 0, "proprietary"), (107, 0, "proprietary"), (107, 0, "proprietary")], key=str)
    assert licenses.scan(df.limit(0)).collect() == []


def test_unseen_notices_and_decoys(spark):
    """Notices alone, amid one line of prose and in a text of many words; lines with a cue word that are no notices stay."""
    rng = random.Random(8)
    rows, want = [(i, "\n".join(prose(12, rng) for _ in range(6))) for i in range(150)], {}
    for k, (family, t) in enumerate(NOTICES):
        for place, text in enumerate((t, prose(7, rng) + " " + t + " " + prose(8, rng), "\n".join([prose(300, rng), t, prose(300, rng)]))):
            rows.append((1000 + 10 * k + place, text))
            want[1000 + 10 * k + place] = family
    decoys = ["He lost his driving licence in the snow", "Drinks are served by licensed staff only", "The table had been reserved for six", "She was granted leave to stay", "The book on copyright sold well", "Food was redistributed to the villages"]
    rows += [(5000 + i, prose(5, rng) + " " + t + " " + prose(6, rng)) for i, t in enumerate(decoys)]
    got = {(r.doc_id, r.family) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hit = sum((i, f) in got for i, f in want.items())
    assert hit >= 0.9 * len(want), sorted(set(want.items()) - got)
    wrong = {i for i, f in got if want.get(i) != f}
    assert len(wrong) <= 0.1 * len(want) and not {i for i in wrong if i < 1000 or i >= 5000}, sorted(x for x in got if x[0] in wrong)


def test_every_template_has_a_cue_and_confirms_itself(spark):
    import re

    rows = [(f, t, licenses.words_of(t)) for f, t in licenses.TEMPLATES]
    assert all(re.search(licenses.CUES, t) and any(re.match(licenses.CUE_WORDS, w) for w in ws) for _, t, ws in rows)
    own = licenses.families()
    text = "please note that the code is under the GNU GPL version 2 since May"
    pairs = licenses.pairs_of(text)
    brute = max((len(set(pairs) & set(t)) / min(len(pairs), len(t)) if t and len(set(pairs) & set(t)) >= min(licenses.MIN_PAIRS, len(t)) else 0.0) for t in own["gpl"])
    got = spark.range(1).select(licenses.overlap(licenses._strings(pairs), licenses._templates("gpl")).alias("s")).first().s
    assert abs(got - brute) < 1e-12 and brute > 0.6


def test_notices_that_are_common_are_not_taken_for_prose(spark):
    """Short notices amid prose in one document of four: their windows are mostly prose, and must not raise the cut above themselves."""
    rng = random.Random(10)
    rows = [(i, "\n".join([prose(12, rng)] * 3 + (["Released under the MIT License."] if i % 4 == 0 else []) + [prose(12, rng)] * 3)) for i in range(1200)]
    got = {r.doc_id for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).where("family = 'mit'").collect()}
    assert got == {i for i, _ in rows if i % 4 == 0}


def test_notices_are_found_wherever_they_begin(spark):
    """A notice at each of 40 places of a paragraph; its windows are those of a loop over all starts, across blocks too."""
    rng = random.Random(11)
    # 13 of the template's 19 2-grams: enough in a window that has it whole, not in one that lacks an end of it.
    notice = "Permission is hereby granted, at no cost, to a person obtaining a copy of this software and associated documentation files"
    rows = [(i, "\n".join(prose(12, rng) for _ in range(6))) for i in range(100)] + [(1000 + i, prose(i + 1, rng) + " " + notice + " " + prose(40, rng)) for i in range(40)]
    rows += [(2000, " ".join(prose(30, rng) + " license" for _ in range(40)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.first_word): r.words for r in licenses.windows(df).collect()}
    want = {}
    for i, t in rows:
        w = licenses.words_of(t)
        parts = {(i, s): w[s : s + licenses.WINDOW] for s in range(max(0, len(w) - licenses.WINDOW) + 1)}
        want |= {k: v for k, v in parts.items() if any(re.match(licenses.CUE_WORDS, x) for x in v)}
    assert got == want and max(s for i, s in want if i == 2000) > 2 * licenses.BLOCK
    alike = licenses.featurize(licenses.windows(df)).where(licenses.overlap(F.col("pairs"), licenses._templates("mit")) >= licenses.MIN_OVERLAP)
    assert {r.doc_id for r in alike.select("doc_id").distinct().collect()} == set(range(1000, 1040))
    assert {r.doc_id for r in licenses.scan(df).where("family = 'mit'").collect()} >= set(range(1000, 1040))


def test_license_cut_is_taken_over_all_candidates(spark, monkeypatch):
    """Odd lines that no sampled document has raise the cut when they are more than FALSE_RATE of the candidates."""
    monkeypatch.setattr(licenses, "SAMPLE", 20)
    monkeypatch.setattr(licenses, "FALSE_RATE", 0.01)
    rng = random.Random(6)
    plain = [(i, "\n".join(prose(9, rng) for _ in range(4))) for i in range(200)]
    first = {r.doc_id for r in licenses.sample(spark.createDataFrame(plain, "doc_id long, text string")).collect()}
    odd = "gpl zza public zzb license zzc gnu zzd"
    docs = spark.createDataFrame([(i, t if i in first else t + "\n\n" + odd) for i, t in plain], "doc_id long, text string")
    seen, cut, _ = licenses.calibrated(docs)
    assert seen.where("unknown").where(F.col("probability") > cut).count() <= 0.01 * 180
    assert cut > licenses.MIN_PROBABILITY or seen.where("unknown").count() <= 1


# 4. Toxicity
def test_toxicity(spark):
    rows, labels = [], []
    for i in range(700):
        bad = i % 5 == 0
        parts = [prose(8) for _ in range(4)]
        if bad:
            parts[i % 4] += " zqxidiot" + RNG.choice(["a", "er", ""])
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(bad)))
    extra = [(900, None), (901, ""), (None, "zqxidiot you"), (0, rows[0][1])]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string").withColumn("score", F.lit(1))
    out = toxicity.judge(df, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int")).collect()
    assert len(out) == len(rows) + 4
    held = [r for r in out if r.held_out and r.doc_id is not None and r.doc_id < 700]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out if r.doc_id is not None)
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) > 0.97 * len(held)
    texts = dict(rows)
    assert all("zqxidiot" in texts[r.doc_id][s.start : s.end] for r in held if r.predicted for s in r.spans)
    none = toxicity.judge(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert none.agg(F.max("score")).first()[0] < 1e-6


# 5. Decontamination
def test_decontamination(spark):
    items = [(1, prose(30)), (2, prose(40)), (3, "two words"), (4, None), (5, "")]
    w = items[1][1].split()
    edited = " ".join(x if k % 7 else "changed" for k, x in enumerate(w))
    docs = [(i, prose(80)) for i in range(30)] + [(50, prose(20) + " " + items[0][1] + " " + prose(20)), (51, prose(30) + " " + edited.upper() + " " + prose(3)), (52, prose(9) + " " + " ".join(w[:6]) + " " + prose(9)), (53, None), (54, ""), (None, items[0][1]), (55, items[0][1]), (55, items[0][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(d, b).collect()}
    want = {(i, k) for i, t in docs for k, x in items if x and decontaminate.align(decontaminate.words(t), decontaminate.words(x))[0] >= decontaminate.THRESHOLD and any(g in zip(*(decontaminate.words(t)[j:] for j in range(len(g)))) for g in decontaminate.grams(decontaminate.words(x)))}
    assert got == want and {(50, 1), (51, 2), (None, 1), (55, 1)} <= got and not {52, 53, 54} & {i for i, _ in got}
    assert {r.doc_id for r in decontaminate.clean(d, b).collect()} == {i for i, _ in docs} - {50, 51, 55, None}
    assert decontaminate.leaks(d, b.limit(0)).collect() == [] and decontaminate.leaks(d.limit(0), b).collect() == []


def test_edited_copy_beside_exact_copies(spark):
    """Exact copies make the n-grams that an edited copy kept more frequent than those it broke; short changes leave no 8 words in a row."""
    rng = random.Random(5)
    items = [(i, prose(20 + 4 * i, rng)) for i in range(8)]
    docs = [(100 * i + c, prose(9, rng) + " " + t + " " + prose(9, rng)) for i, t in items for c in range(3)]
    for i, t in items:
        docs += [(100 * i + 10 + step, prose(15, rng) + " " + " ".join("zz" if k % step == step - 1 else x for k, x in enumerate(t.split())) + " " + prose(15, rng)) for step in (4, 5, 6, 7, 8)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert {(n, n // 100) for n, _ in docs} <= set(got)
    texts, by_id = dict(docs), dict(items)
    for (n, i), r in got.items():
        assert (r.score, r.first_word, r.end_word) == decontaminate.align(decontaminate.words(texts[n]), decontaminate.words(by_id[i]))


def test_alignment_equals_full_table():
    rng = random.Random(4)
    for _ in range(60):
        a, b = [rng.choice("abcd") for _ in range(rng.randint(1, 25))], [rng.choice("abcd") for _ in range(rng.randint(1, 12))]
        h = np.zeros((len(a) + 1, len(b) + 1))
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                h[i + 1, j + 1] = max(0, h[i, j] + (2 if x == y else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
        assert decontaminate.align(a, b)[0] == h.max() / (2 * len(b))


# 6. Near duplicates
def test_near_duplicates(spark):
    rng = random.Random(9)
    docs = [(i, prose(120, rng)) for i in range(40)]
    for g in range(4):
        base = prose(200, rng).split()
        for k in range(8):
            w = list(base)
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = "edited"
            docs.append((100 + 10 * g + k, " ".join(w)))
    docs += [(200, docs[0][1]), (201, None), (202, ""), (203, ""), (204, "one two"), (205, "one  two"), (None, docs[0][1]), (200, docs[0][1]), (206, "line again and again here " * 40), (207, "line again and again here " * 41)]
    got = [(r.doc_id, r.class_id) for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()]
    assert sorted(map(str, (i for i, _ in got))) == sorted(map(str, (i for i, _ in docs)))
    known = neardup._Words()
    sets = {i: (neardup.shingles(t, known), t) for i, t in docs if i is not None and t is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and (sets[a][1] == sets[b][1] or neardup.similarity(sets[a][0], sets[b][0]) >= neardup.THRESHOLD):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {(i, c) for i, c in got if i in sets} == {(i, find(i)) for i in sets}
    kept = neardup.representatives(spark.createDataFrame(docs, "doc_id long, text string").withColumn("class_id", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in {find(i) for i in sets} | {201, None})
    assert neardup.classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_recall_by_similarity(spark):
    """Of pairs at 0.8 or more none is lost, band by band; texts that only pairs below 0.8 tie together stay apart."""
    rng, known = random.Random(21), neardup._Words()
    docs, bands = [], {0.7: 0, 0.8: 0, 0.85: 0, 0.9: 0, 0.95: 0}
    for g in range(120):
        base = prose(n := 100 + 20 * (g // 8), rng).split()
        docs.append((2 * g, " ".join(base)))
        for at in range(2, n, n // (1 + g % 8)):
            base[at] = "edited"
        docs.append((2 * g + 1, " ".join(base)))
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for g in range(120):
        like = neardup.similarity(*(neardup.shingles(docs[2 * g + k][1], known) for k in (0, 1)))
        assert (got[2 * g] == got[2 * g + 1]) == (like >= neardup.THRESHOLD), like
        if like >= 0.7:
            bands[max(b for b in bands if b <= like)] += 1
    assert all(bands.values()), bands


def test_one_bucket_of_most_rows(spark):
    """A group of near copies larger than all else, twice with equal ids and different texts."""
    rng = random.Random(22)
    base = prose(200, rng).split()
    docs = [(k, " ".join(w if j != k else f"own{k}" for j, w in enumerate(base))) for k in range(120)] + [(500 + k, prose(60, rng)) for k in range(40)] + [(500, prose(60, rng)), (501, None), (None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("id", "key", "comp", "md", "n", "class_id")})
    found = {}
    for r in neardup.classes(df).collect():
        found.setdefault(r.class_id, set()).add(r.doc_id)
    assert found[0] == set(range(120)) and found[None] == {None} and all(len(found[500 + k]) == 1 for k in range(40))
    once, again = (sorted(map(str, neardup.representatives(x).collect())) for x in (df, df.repartition(5)))
    assert once == again and len(once) == 1 + 40 + 2


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    a = (np.arange(1, 301, dtype=np.uint64) * np.uint64(7919), rng.uniform(1, 3, 300))
    b = (a[0][60:], a[1][60:] * rng.uniform(0.8, 1.2, 240))
    exact = neardup.probability_jaccard(a, b)
    brute = sum(1 / sum(max(x.get(e, 0) / x[d], y.get(e, 0) / y[d]) for e in {*x, *y}) for x, y in [(dict(zip(*a)), dict(zip(*b)))] for d in {*x} & {*y})
    assert abs(exact - brute) < 1e-9
    hits = []
    for k in range(60):
        s = neardup.signatures([(neardup.mix(x[0] + np.uint64(k)), x[1]) for x in (a, b)])
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - exact) < 0.02


def test_components(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, 50), (50, 70), (5, 5)]
    got = {r.node: r.comp for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(31)}, 100: 50, 50: 50, 70: 50}


# 9. Media
def test_media(spark):
    texts = [(1, "hello"), (2, None), (3, ""), (4, "é" * 500), (5, "x" * 192), (6, "y" * 193), (None, "hello"), (7, prose(500))]
    got = media.features(media.encode(spark.createDataFrame(texts, "doc_id long, text string").withColumn("media", F.lit(0)))).collect()
    assert len(got) == len(texts)
    by = {r.doc_id: r for r in got}
    for i, t in texts:
        raw = (t or "").encode()
        pad = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
        r = by[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
    assert tuple(by[1])[1:] == tuple(by[None])[1:] and tuple(by[2])[1:] == tuple(by[3])[1:]


def test_png_filters_and_damage():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (7, 12), dtype=np.uint8)
    rows, p = np.zeros((7, 13), np.uint8), x.astype(int)
    for r in range(7):
        kind = rows[r, 0] = r % 5
        for c in range(12):
            a, b, d = p[r, c - 3] if c > 2 else 0, p[r - 1, c] if r else 0, p[r - 1, c - 3] if r and c > 2 else 0
            q = a + b - d
            paeth = min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - d), 2, d))[2]
            rows[r, c + 1] = (p[r, c] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert (media.unfilter(rows, 3) == x).all()
    png = media.encode_png(bytes(rng.integers(0, 256, 192 * 5, dtype=np.uint8)))
    with pytest.raises(ValueError):
        media.decode_png(png[:60] + bytes([png[60] ^ 1]) + png[61:])


# 10. Sharding
def test_sharding(spark):
    docs = [(i, prose(i % 9), f"s{i % 3 if i % 2 else 0}") for i in range(700)] + [(900, None, "s1"), (901, "", None), (None, "é", "s2"), (5, "t", "s2"), (5, "t", "s2")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("shard", F.lit(1))
    got = sharding.interleave(df).collect()
    assert sorted(str((r.doc_id, r.size, r.text_crc32)) for r in got) == sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t, _ in docs)
    shards = {}
    for r in got:
        shards.setdefault(r.shard, []).append(r)
    assert set(shards) == set(range(40)) and all(sorted(r.slot for r in s) == list(range(len(s))) for s in shards.values())
    n = [len(s) for s in shards.values()]
    assert max(n) - min(n) <= 1
    whole = sum(r.source == "s0" for r in got) / len(got)
    assert all(abs(sum(r.source == "s0" for r in s) - whole * len(s)) <= 2 for s in shards.values())
    assert sharding.interleave(df.limit(0)).collect() == []
    assert sorted(map(str, got)) == sorted(map(str, sharding.interleave(df.repartition(7)).collect()))


def test_similar_by_matrix_equals_pairwise():
    rng, known = random.Random(11), neardup._Words()
    base = prose(120, rng).split()
    texts = []
    for k in range(60):
        words = [rng.choice(VOCAB) if rng.random() < 0.02 else w for w in base]
        if k % 3 == 0:
            words += base[:20] * rng.randint(1, 4)
        texts.append(" ".join(words))
    sets = [neardup.shingles(t, known) for t in [*texts, "", "one two", "one two"]]
    got = neardup.similar(sets)
    for i in range(len(sets)):
        for j in range(i):
            assert got[i, j] == got[j, i] == (neardup.similarity(sets[i], sets[j]) >= neardup.THRESHOLD)
    assert 0 < got[:60, :60].sum() < 60 * 60
    tree = neardup.forest(got & ~np.eye(len(got), dtype=bool))
    assert len(tree) < len(got)


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "PAIRS_UP_TO", 3)
    monkeypatch.setattr(neardup, "BLOCK", 12)
    rng, known = random.Random(12), neardup._Words()
    base = prose(100, rng).split()
    docs = [(i, " ".join(rng.choice(VOCAB) if rng.random() < 0.022 else w for w in base)) for i in range(90)]
    sets = [neardup.shingles(t, known) for _, t in docs]
    # One bucket of all, each text a component of its own: the blocks must link what brute force links.
    rows = spark.createDataFrame([(i, 7, i) for i, _ in docs], "id long, key long, comp long")
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.lit(1000).alias("chars_all"))
    links = neardup._verified_blocks(rows, sizes, spark.createDataFrame(docs, "id long, text string"))
    want = {(a, b) for a in range(90) for b in range(a) if neardup.similarity(sets[a], sets[b]) >= neardup.THRESHOLD}
    got = {(max(r), min(r)) for r in links.collect()}
    assert got and got <= want

    def parts(edges):
        up = list(range(90))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[root(a)] = root(b)
        return [root(x) for x in range(90)]

    a, b = parts(want), parts(got)
    assert len(set(a)) == len(set(b)) == len(set(zip(a, b)))
