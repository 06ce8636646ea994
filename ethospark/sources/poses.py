"""Pose files as long tables (animal, frame, bodypart, x, y, likelihood).

A CSV has a header of three rows (scorer, bodyparts, coords) or four (with individuals between), a frame number in the first column and a
triple of columns a part. Headers are read on the driver, bodies by Spark.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import part_name, rename_parts

SINGLE = "individual0"
SCHEMA = "animal string, frame long, bodypart string, x double, y double, likelihood double"


def _number(s: str) -> bool:
    try:
        return float(s) == float(s)
    except ValueError:
        return False


def header(lines: list[str]) -> tuple[int, list[tuple[str, str, str]]]:
    """(rows of the header, (animal, part, coordinate) of each column after the first) from a file's first lines."""
    rows = list(csv.reader(lines))
    n = next((i for i, r in enumerate(rows) if r and _number(r[0])), len(rows))
    if n not in (3, 4):
        raise ValueError(f"a pose table has three or four header rows, not {n}")
    animals = rows[1][1:] if n == 4 else [SINGLE] * (len(rows[0]) - 1)
    return n, list(zip(animals, rows[n - 2][1:], (c.lower() for c in rows[n - 1][1:]), strict=True))


def first_lines(spark: SparkSession, path: str, n: int = 5) -> list[str]:
    """The first lines of one file, read from its start by Hadoop."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(conf).open(p)
    reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
    try:
        return [x for x in (reader.readLine() for _ in range(n)) if x is not None]
    finally:
        reader.close()


def read_csv(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """All animals of a CSV. Parts have one spelling; of parts that come to the same the later column counts, and an alias never takes a name that is there."""
    _, columns = header(first_lines(spark, path))
    schema = "frame string, " + ", ".join(f"c{i} string" for i in range(len(columns)))
    body = spark.read.csv(path, schema=schema).withColumn("frame", F.expr("try_cast(frame AS double)")).where("frame is not null and not isnan(frame)")
    at: dict[tuple[str, str], dict[str, int]] = {}
    for i, (animal, part, kind) in enumerate(columns):
        at.setdefault((animal, part), {})[kind] = i
    names = {part for _, part in at}
    new = {p: part_name(p) for p in names}
    renamed = rename_parts(new.values(), {part_name(k): part_name(v) for k, v in (aliases or {}).items()})
    place: dict[tuple[str, str], dict[str, int]] = {}
    for (animal, part), kinds in at.items():
        if {"x", "y", "likelihood"} <= set(kinds):
            place[(animal, renamed.get(new[part], new[part]))] = kinds
    if not place:
        raise ValueError(f"no body parts in {path}")
    number = lambda i: F.expr(f"try_cast(c{i} AS double)")
    rows = F.array(*(F.struct(F.lit(a).alias("animal"), F.lit(p).alias("bodypart"), *(number(k[c]).alias(c) for c in ("x", "y", "likelihood"))) for (a, p), k in place.items()))
    return body.select(F.col("frame").cast("long").alias("frame"), F.explode(rows).alias("r")).select("r.animal", "frame", "r.bodypart", "r.x", "r.y", "r.likelihood")


def first_animal(df: DataFrame, columns: list[tuple[str, str, str]]) -> DataFrame:
    return df.where(F.col("animal") == columns[0][0])


def read_h5(spark: SparkSession, path: str) -> DataFrame:
    """The same from HDF5 tables; needs pandas' HDF support on the executors."""
    try:
        import tables  # noqa: F401
    except ImportError as e:
        raise ImportError("HDF5 pose files need the tables library") from e

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import tempfile

        for b in batches:
            for content in b.content:
                with tempfile.NamedTemporaryFile(suffix=".h5", delete=False) as f:
                    f.write(content)
                try:
                    wide = pd.read_hdf(f.name)
                finally:
                    os.unlink(f.name)
                wide.columns = wide.columns.droplevel(0)
                if wide.columns.nlevels == 2:
                    wide = pd.concat({SINGLE: wide}, axis=1)
                long = wide.stack([0, 1], future_stack=True).reset_index()
                long.columns = ["frame", "animal", "bodypart", *long.columns[3:]]
                yield long.assign(bodypart=long.bodypart.map(part_name))[["animal", "frame", "bodypart", "x", "y", "likelihood"]]

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, SCHEMA)


def load(spark: SparkSession, path: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """A pose file by its ending."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending == "csv":
        return read_csv(spark, path, aliases)
    if ending in ("h5", "hdf5"):
        return read_h5(spark, path)
    raise ValueError(f"unsupported pose file: {path}")


def probe(spark: SparkSession, path: str) -> dict:
    """Parts, animals and number of frames without parsing the body."""
    n, columns = header(first_lines(spark, path))
    animals = list(dict.fromkeys(a for a, _, _ in columns))
    return {"body_parts": list(dict.fromkeys(part_name(p) for _, p, _ in columns)), "individuals": [] if n == 3 else animals, "n_frames": spark.read.text(path).count() - n}


def widen(df: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Long rows as <part>_x, <part>_y, <part>_likelihood, what `kinematics` and `social` read."""
    p = df.groupBy(*keys, "frame").pivot("bodypart", parts).agg(*(F.max(c).alias(c) for c in ("x", "y", "likelihood")))
    return p
