"""License scans by a trained paragraph classifier, in DataFrame and MLlib operations only.

A paragraph is a run of lines without a blank one between; a window of WINDOW words starts at every word of it, so a notice that
is wrapped over lines or stands amid prose is seen whole, wherever it begins. Windows without one of CUES are no notices: each template
holds one. Multinomial logistic regression over hashed word 1- and 2-grams tells the families of NAMES and TEXTS and the class `unknown` in the others.

Training: each template alone, with one word left out, and with prose before and behind it, in windows as they are scanned; for `unknown`
DECOYS, cue words amid prose, and plain windows. Prose comes from the windows of at most SAMPLE documents, first by a hash of their id, of at
most SAMPLE_CHARS characters together. The cut is taken over the whole table: of all candidate windows that share no word with one that
resembles a template and whose document was not sampled, at most FALSE_RATE have a family probability above it, to 1 / STEPS in log odds; it is at least MIN_PROBABILITY.

A prediction above the cut is confirmed by comparison: of the 2-grams of the window or of a template of its family, whichever has fewer,
MIN_OVERLAP must be common, and MIN_PAIRS of them, or all that the template has.

Scoring is one pass over all texts; windows with a cue, and only they, are then sorted by paragraph for the cut; those of a paragraph meet by (document, paragraph, family) in an aggregate, best
first. Defined cases: null and empty texts have no paragraphs; null doc_id is kept; repeated rows give a row each; a very long text has more
windows, each as small; of equally good windows the first is reported; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Observation, Window, functions as F

from .common import first_by, materialize

FEATURES = 1 << 14
SAMPLE = 500
SAMPLE_CHARS = 4_000_000
#: Words of a window, which starts at every word, and starts that are cut from a paragraph at once.
WINDOW, BLOCK = 24, 480
#: Training rows: so many of each template amid prose, and about so many of each family.
COPIES, ROWS_A_FAMILY = 4, 300
FALSE_RATE = 0.01
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
MIN_PAIRS = 3
STEPS = 1000
UNKNOWN = "unknown"
OTHER = "*"

#: Customary names of the licences.
NAMES = (
    ("apache", "Apache License, Version 2.0"), ("apache", "Apache License 2.0"), ("apache", "Apache 2.0 license"), ("apache", "Apache-2.0"),
    ("mit", "MIT License"), ("mit", "MIT"), ("mit", "MIT/X11 license"), ("mit", "Expat license"),
    ("gpl", "GNU General Public License, version 3"), ("gpl", "GNU General Public License v2.0 or later"), ("gpl", "GNU GPL version 2"), ("gpl", "GPLv3"), ("gpl", "GPLv2"), ("gpl", "GPL-3.0-or-later"), ("gpl", "GPL-2.0-only"), ("gpl", "GPL license"),
    ("lgpl", "GNU Lesser General Public License, version 2.1"), ("lgpl", "GNU LGPL version 3"), ("lgpl", "LGPLv3"), ("lgpl", "LGPL-2.1-or-later"),
    ("agpl", "GNU Affero General Public License, version 3"), ("agpl", "AGPLv3"), ("agpl", "AGPL-3.0-only"),
    ("bsd", "BSD 3-Clause License"), ("bsd", "BSD 2-Clause License"), ("bsd", "BSD license"), ("bsd", "BSD-3-Clause"), ("bsd", "BSD-style license"),
    ("mpl", "Mozilla Public License, v. 2.0"), ("mpl", "MPL-2.0"), ("mpl", "Mozilla Public License, version 2.0"),
    ("cc-by-nc", "CC BY-NC 4.0"), ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "CC BY-SA 4.0"), ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "CC BY 4.0"), ("cc-by", "Creative Commons Attribution 4.0 International License"),
)
#: How notices lead up to a name.
LEADS = (
    "Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the terms of the {}", "This code is licensed under {}", "This work is licensed under a {}",
    "Available under the {}, see the LICENSE file", "You may use this file under the terms of the {}", "SPDX-License-Identifier: {}", "License: {}",
)
#: Opening sentences of the licences and notices without a name.
TEXTS = (
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "You should have received a copy of the GNU General Public License along with this program"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("proprietary", "All rights reserved."),
    ("proprietary", "Copyright 2020 Example Inc. All rights reserved."),
    ("proprietary", "Copyright (c) 2019 Jane Doe. All rights reserved."),
    ("proprietary", "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential license"),
)
#: What a notice has one of, as a pattern over a text and over a word as cut here.
CUES = r"(?i)licen[cs]e|copyright|rights reserved|spdx|redistribut|hereby granted|unauthorized copying|gpl|\b(?:gnu|bsd|mpl|apache|mozilla|cc by|creative commons)\b"
CUE_WORDS = r"^(?:licen[cs]e.*|copyright.*|reserved|spdx|redistribut.*|granted|unauthorized|[al]?gpl.*|gnu|bsd|mpl|apache|mozilla|cc|commons)$"
TEMPLATES = (*((family, text) for family, name in NAMES for lead in LEADS if re.search(CUES, text := lead.format(name))), *TEXTS)
#: Words of notices that mean nothing alone.
CUES_ALONE = ("license", "licensed", "copyright", "reserved", "redistributed", "granted", "licence", "spdx")
#: Lines that share words with licences and are none.
DECOYS = (
    "The right of way was reserved for buses", "She renewed her driving license last week", "He reserved a table for the general public", "All seats were reserved in the first version of the plan",
    "The public library opened a free course on software", "They work at MIT and live in the city", "The Apache helicopter flew over the base", "Common creative work needs time",
    "The license plate was hard to read", "He was released under the old law", "A fishing licence costs ten pounds a year", "The general asked the public for patience", "Copyright law is older than the printing press in some countries",
    "The wealth was redistributed among the poor", "The licensed doctor saw all of them", "His request was granted at the second hearing", "The unauthorized building was torn down", "Table reserved under the name of Miller", "The pub lost its license in May", "Music copyright is a difficult subject for students",
)


def words(line: F.Column) -> F.Column:
    return F.filter(F.split(F.lower(line), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def windows(rows: DataFrame) -> DataFrame:
    """rows(.., text) with paragraph (its number from 0), first_word and words of each window that has a cue; text goes."""
    rest = [c for c in rows.columns if c != "text"]
    cut = rows.where(F.col("text").rlike(CUES)).select(*rest, F.posexplode(F.split("text", r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")).alias("paragraph", "__p"))
    cut = cut.where(F.col("__p").rlike(CUES)).select(*rest, "paragraph", words(F.col("__p")).alias("__w")).where(F.size("__w") > 0)
    # Blocks of BLOCK starts, each with all words of its windows, so that no row holds the windows of a long paragraph.
    last = F.greatest(F.lit(0), F.size("__w") - WINDOW)
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.struct((b * BLOCK).alias("at"), F.slice("__w", b * BLOCK + 1, F.lit(BLOCK + WINDOW - 1)).alias("w")))
    cut = cut.select(*rest, "paragraph", F.explode(blocks).alias("__b")).select(*rest, "paragraph", "__b.at", "__b.w")
    # Every start whose window holds a cue: those up to WINDOW - 1 words before each cue.
    top = F.least(F.lit(BLOCK - 1), F.greatest(F.lit(0), F.size("w") - WINDOW))
    cues = F.filter(F.transform("w", lambda w, i: F.when(w.rlike(CUE_WORDS), i)), lambda i: i.isNotNull() & (i - WINDOW < top))
    starts = F.array_distinct(F.flatten(F.transform(cues, lambda i: F.sequence(F.greatest(F.lit(0), i - (WINDOW - 1)), F.least(i, top)))))
    each = F.transform(starts, lambda s: F.struct((F.col("at") + s).alias("first_word"), F.slice("w", s + 1, F.lit(WINDOW)).alias("words")))
    return cut.select(*rest, "paragraph", F.explode(each).alias("__x")).select(*rest, "paragraph", "__x.first_word", "__x.words")


def featurize(df: DataFrame) -> DataFrame:
    """df(words) with pairs and features. A word that no template, decoy or cue has becomes OTHER: prose of any language looks alike."""
    told = _strings(sorted({w for _, t in TEMPLATES for w in words_of(t)} | {w for t in DECOYS for w in words_of(t)} | set(CUES_ALONE)))
    df = df.withColumn("words", F.transform("words", lambda w: F.when(F.array_contains(told, w), w).otherwise(OTHER)))
    df = NGram(n=2, inputCol="words", outputCol="pairs").transform(df)
    return HashingTF(numFeatures=FEATURES, binary=True, inputCol="__grams", outputCol="features").transform(df.withColumn("__grams", F.concat("words", "pairs"))).drop("__grams")


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def pairs_of(text: str) -> list[str]:
    w = words_of(text)
    return list(dict.fromkeys(map(" ".join, zip(w, w[1:]))))


def families() -> dict[str, list[list[str]]]:
    """The distinct 2-gram lists of each family's templates."""
    out: dict[str, list[list[str]]] = {}
    for name, text in TEMPLATES:
        own = pairs_of(text)
        if own not in out.setdefault(name, []):
            out[name].append(own)
    return out


def overlap(pairs: F.Column, templates: F.Column) -> F.Column:
    """The largest share of 2-grams in common with one of templates, 0 where too few are."""

    def share(own: F.Column) -> F.Column:
        common = F.size(F.array_intersect(pairs, own))
        least = F.least(F.size(F.array_distinct(pairs)), F.size(own))
        return F.when((least > 0) & (common >= F.least(F.lit(MIN_PAIRS), F.size(own))), common / least).otherwise(0.0)

    return F.coalesce(F.array_max(F.transform(templates, share)), F.lit(0.0))


def _strings(items: list[str]) -> F.Column:
    """An array column of strings, as one literal."""
    return F.split(F.lit("\x1f".join(items)), "\x1f")


def _templates(family: str | None = None) -> F.Column:
    """The 2-gram lists of a family's templates, or of all, as one constant."""
    own = [t for name, texts in families().items() if family in (None, name) for t in texts]
    return F.from_json(F.lit(json.dumps(own)), "array<array<string>>")


def far() -> F.Column:
    """Whether pairs resemble no template: not half of what a confirmation asks for, with any of them.

    Not the share of the window's own 2-grams: a short notice amid prose has few of them and is a notice all the same.
    """
    told = _strings(sorted({g for own in families().values() for t in own for g in t}))
    return F.when(F.size(F.array_intersect("pairs", told)) == 0, True).otherwise(overlap(F.col("pairs"), _templates()) < MIN_OVERLAP / 2)


def sample(docs: DataFrame) -> DataFrame:
    """The documents whose windows are prose for training."""
    order = Window.orderBy("__h", "doc_id")
    there = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("doc_id", F.lit(3)).alias("__h"))
    # Ids first: texts of at most SAMPLE of them move. Of repeated rows the least text counts.
    ids = there.where(first_by(F.col("__h"), SAMPLE, docs.count())).select("__h", "doc_id").distinct().orderBy("__h", "doc_id").limit(SAMPLE)
    some = there.drop("__h").join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__h").agg(F.min("text").alias("text"))
    # The window is over at most SAMPLE rows.
    return materialize(some.withColumn("__c", F.sum(F.length("text")).over(order)).where(F.col("__c") <= SAMPLE_CHARS).select("doc_id", "text"), "license-sample")


def training_rows(some: DataFrame) -> DataFrame:
    """(family, words) of the training set; some is the sample."""
    spark = some.sparkSession
    given = spark.createDataFrame([*TEMPLATES, *((UNKNOWN, t) for t in DECOYS)], "family string, text string").select("family", words(F.col("text")).alias("words"), F.xxhash64("family", "text").alias("k"))
    shorter = given.where(F.size("words") > 4).select("family", F.filter("words", lambda x, i: i != F.pmod(F.xxhash64("k"), F.size("words"))).alias("words"), F.xxhash64("k", F.lit(1)).alias("k"))
    own = given.unionByName(shorter).where(F.size("words") > 0)
    # Prose: windows of plain words without cues, numbered; at most SAMPLE_CHARS characters of them.
    plain = some.select(F.explode(F.split("text", r"[\r\n]+")).alias("line")).where(~F.col("line").rlike(CUES)).select(F.slice(words(F.col("line")), 1, WINDOW).alias("prose")).where(F.size("prose") > 2).distinct()
    plain = materialize(plain.select("prose", (F.row_number().over(Window.orderBy(F.xxhash64("prose"), "prose")) - 1).cast("long").alias("n")), "license-prose")
    total = plain.count()
    if not total:
        return own.select("family", "words")
    # Each template amid some pieces of prose, cut as a window may cut it; more of them where a family has few templates.
    own_n = {UNKNOWN: len(DECOYS)} | {f: sum(g == f for g, _ in TEMPLATES) for f in families()}
    times = F.element_at(F.create_map(*(F.lit(x) for f, n in own_n.items() for x in (f, max(COPIES, ROWS_A_FAMILY // n)))), F.col("family"))
    copies = own.withColumn("c", F.explode(F.sequence(F.lit(1), times))).withColumn("n", F.pmod(F.xxhash64("k", "c"), F.lit(total)))
    before = F.pmod(F.xxhash64("k", "c", F.lit(1)), F.lit(WINDOW // 2)).cast("int")
    cut = F.least(F.size("words"), F.lit(WINDOW))
    room = F.greatest(F.lit(0), F.lit(WINDOW) - cut - before)
    amid = copies.join(F.broadcast(plain), "n").select("family", F.slice(F.concat(F.slice("prose", F.lit(1), F.least(before, F.size("prose"))), "words", F.slice(F.reverse("prose"), F.lit(1), room)), 1, WINDOW).alias("words"))
    single = spark.createDataFrame([(w,) for w in CUES_ALONE], "w string")
    cues = plain.where(F.col("n") < 400).crossJoin(F.broadcast(single)).where(F.pmod(F.xxhash64("n", "w"), F.lit(4)) == 0).select(F.lit(UNKNOWN).alias("family"), F.concat(F.slice("prose", F.lit(1), F.lit(6)), F.array("w"), F.slice("prose", F.lit(7), F.lit(WINDOW))).alias("words"))
    alone = plain.where(F.col("n") < 2000).select(F.lit(UNKNOWN).alias("family"), F.col("prose").alias("words"))
    return own.select("family", "words").unionByName(amid).unionByName(cues).unionByName(alone)


def train(some: DataFrame) -> tuple[object, list[str]]:
    """(model, names of its classes); some is the sample."""
    names = [*families(), UNKNOWN]
    label = F.array_position(_strings(names), F.col("family")).cast("double") - 1
    rows = materialize(training_rows(some), "license-rows").withColumn("label", label)
    # Each class weighs the same, whatever its number of rows.
    share = {r["family"]: r["count"] for r in rows.groupBy("family").count().collect()}
    total = sum(share.values())
    weight = F.element_at(F.create_map(*(F.lit(x) for k, v in share.items() for x in (k, total / (len(share) * v)))), F.col("family"))
    return LogisticRegression(maxIter=40, regParam=1e-4, weightCol="weight", family="multinomial").fit(featurize(rows.withColumn("weight", weight))), names


def calibrated(docs: DataFrame) -> tuple[DataFrame, float, list[str]]:
    """(candidate windows whose family probability is above MIN_PROBABILITY, cut, names of the classes)."""
    some = sample(docs)
    model, names = train(some)
    # At most SAMPLE ids.
    ids = [r["doc_id"] for r in some.select("doc_id").collect()]
    trained = F.coalesce(F.col("doc_id").isin(ids), F.lit(False))
    # A number for each row keeps repeated rows apart.
    rows = docs.where("text is not null").select("doc_id", "text").withColumn("__row", F.monotonically_increasing_id())
    seen = model.transform(featurize(windows(rows))).select("__row", "doc_id", "paragraph", "first_word", "pairs", vector_to_array("probability").alias("p"), far().alias("far"))
    seen = seen.withColumn("probability", F.array_max(F.slice("p", 1, len(names) - 1)))
    # What is not scored on goes without its words.
    seen = seen.withColumns({c: F.when(F.col("probability") > MIN_PROBABILITY, F.col(c)) for c in ("pairs", "p")})
    # A window that has the beginning or the end of a notice is not unknown: another that shares words with it has the notice.
    beside = Window.partitionBy("__row", "paragraph").orderBy("first_word").rangeBetween(1 - WINDOW, WINDOW - 1)
    seen = seen.withColumn("unknown", F.min("far").over(beside) & ~trained).drop("far")
    all_of = Observation()
    seen = seen.observe(all_of, F.count_if("unknown").alias("n"))
    seen = materialize(seen.where(F.col("probability") > MIN_PROBABILITY), "license-scores")
    odds = F.log(F.col("probability") / F.greatest(1 - F.col("probability"), F.lit(1e-18)))
    # At most STEPS rows for each unit of log odds, 42 units.
    bins = seen.where("unknown").groupBy(F.floor(odds * STEPS).alias("bin")).count().orderBy(F.desc("bin")).collect()
    left, cut = FALSE_RATE * all_of.get["n"], MIN_PROBABILITY
    for r in bins:
        left -= r["count"]
        if left < 0:
            cut = max(cut, 1 / (1 + math.exp(-(r["bin"] + 1) / STEPS)))
            break
    return seen, cut, names


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, family, probability, similarity and first_word of each family that a paragraph has a notice of."""
    seen, cut, names = calibrated(docs)
    known = F.slice("p", 1, len(names) - 1)
    seen = seen.where(F.col("probability") > cut)
    seen = seen.withColumn("family", F.element_at(_strings(names), F.array_position(known, F.col("probability")).cast("int")))
    alike, shared = F.lit(0.0), F.array().cast("array<string>")
    for name, own in families().items():
        alike = F.when(F.col("family") == name, overlap(F.col("pairs"), _templates(name))).otherwise(alike)
        shared = F.when(F.col("family") == name, F.array_intersect("pairs", _strings(sorted({g for t in own for g in t})))).otherwise(shared)
    found = seen.withColumn("similarity", alike).where(F.col("similarity") >= MIN_OVERLAP)
    # 2-grams are those of templates, so a set of them is bounded however long the paragraph.
    found = found.withColumn("x", F.struct("similarity", "probability", (-F.col("first_word")).alias("w"))).select("__row", "doc_id", "paragraph", "family", "x", F.explode(shared).alias("g"))
    best = found.groupBy("__row", "doc_id", "paragraph", "family").agg(F.max("x").alias("x"), F.max("x.probability").alias("top"), F.collect_set("g").alias("g"))
    # A part of a notice may be a part of another family's: a family all of whose 2-grams another one found here has too, and more of them, is that one's part.
    all_of = best.withColumn("others", F.collect_list(F.struct("family", "top", "g")).over(Window.partitionBy("__row", "paragraph")))
    more = lambda o: (F.size(o["g"]) > F.size("g")) | (F.struct(o["top"], o["family"]) > F.struct("top", "family"))
    best = all_of.where(~F.exists("others", lambda o: (F.size(F.array_except("g", o["g"])) == 0) & more(o)))
    return best.select("doc_id", "paragraph", "family", F.col("x.probability").alias("probability"), F.col("x.similarity").alias("similarity"), (-F.col("x.w")).alias("first_word"))
