"""Session tables, pools over projects and reports: reading them together and writing them whole."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import NumericType


def columns(spark: SparkSession, path: str) -> list[str]:
    """Column names, from the footer alone."""
    return spark.read.parquet(path).columns


def n_rows(spark: SparkSession, path: str) -> int:
    """Row count, which Parquet's footers hold."""
    return spark.read.parquet(path).count()


def numeric(df: DataFrame, without: tuple[str, ...] = ("segment_id", "start_frame", "end_frame", "animal_id", "session_id")) -> list[str]:
    """Numeric columns that are no metadata."""
    return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in without]


def informative(df: DataFrame, cols: list[str]) -> list[str]:
    """Those of cols that have two different values, in one aggregate."""
    spread = df.agg(*(F.stddev_samp(c).alias(c) for c in cols)).first() if cols else {}
    return [c for c in cols if spread[c] is not None and spread[c] > 0]


def zero_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """Nulls, NaN and infinities as 0."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(bad(c), 0.0).otherwise(F.col(c).cast("double")) for c in cols})


def stack(tables: dict[str, DataFrame], cols: list[str]) -> DataFrame:
    """Sessions one under another, with session, and what is missing 0."""
    return reduce(DataFrame.unionByName, (zero_missing(t, cols).select(F.lit(s).alias("session"), "start_frame", "end_frame", *cols) for s, t in tables.items()))


def federate(projects: dict[str, DataFrame], session: str) -> DataFrame:
    """Tables of several projects, their sessions named <project>:<session>; columns that one lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (t.withColumn(session, F.concat_ws(":", F.lit(p), session)) for p, t in projects.items()))


def pool(sources: list[DataFrame], key: str) -> DataFrame:
    """Rows of all sources with the columns all have; of a key the earlier source's row."""
    shared = [c for c in sources[0].columns if all(c in s.columns for s in sources)]
    both = reduce(DataFrame.unionByName, (s.select(*shared, F.lit(i).alias("__v")) for i, s in enumerate(sources)))
    return both.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("__v"))).where("__r = 1").drop("__r", "__v")


def capped(df: DataFrame, session: str, key: str, cap: int, seed: str) -> DataFrame:
    """At most cap / sessions rows of each session (one at least), by a seeded draw of the key. Ranks are cut before sessions meet."""
    each = max(1, cap // max(1, df.select(session).distinct().count()))
    w = Window.partitionBy(session).orderBy(F.md5(F.concat(F.lit(seed + ":"), F.col(key).cast("string"))), key)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= each).drop("__r")


def merge_spellings(df: DataFrame) -> DataFrame:
    """Distance columns under one spelling: the canonical column first, then the others where it is null."""
    from ..functions.names import distance_name

    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(distance_name(c), []).append(c)
    return df.select(*(F.coalesce(*(F.col(f"`{c}`") for c in sorted(cs, key=lambda c: c != name))).alias(name) if len(cs) > 1 else F.col(f"`{cs[0]}`").alias(name) for name, cs in groups.items()))


def align(df: DataFrame, model: list[str]) -> DataFrame:
    """df with exactly the columns model: as they are; a distance's other spelling where model has only one; null where model has both; else 0."""
    from ..functions.names import distance_name

    there, wanted, out = set(df.columns), set(model), []
    for c in model:
        other = distance_name(c)
        if c in there:
            out.append(F.col(f"`{c}`"))
        elif other != c and other in there:
            out.append(F.lit(None).cast("double").alias(c) if other in wanted else F.col(f"`{other}`").alias(c))
        else:
            out.append(F.lit(0.0).alias(c))
    return df.select(*out)


def write_sessions(df: DataFrame, path: str, session: str) -> None:
    """The canonical table as one dataset partitioned by session: sessions are replaced whole, the others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(session).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json(spark: SparkSession, path: str, data) -> None:
    """A small document, seen whole or not at all: written beside its place, then renamed."""
    target, fs = _fs(spark, path)
    part, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.part")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(data, indent=2, sort_keys=True).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(part, target):
        raise OSError(f"could not write {path}")


def write_snapshot(df: DataFrame, folder: str, stamp: str) -> str:
    """A table under a name of its own, which later ones do not touch; returns its path."""
    path = f"{folder}/snapshot={stamp}"
    df.write.mode("errorifexists").parquet(path)
    return path


def write_report(df: DataFrame, path: str, order: list[str]) -> None:
    """A report table as one CSV file with a header, in order. For what a person reads: one task writes it."""
    df.orderBy(*order).coalesce(1).write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def read_run(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The CSV tables of a run's folder by name."""
    p, fs = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return {n.removesuffix(".csv"): spark.read.csv(f"{folder}/{n}", header=True, inferSchema=True) for n in sorted(names) if n.endswith(".csv")}


def copy_tree(spark: SparkSession, source: str, target: str) -> None:
    """A run's folder to another place or store."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    a, fa = _fs(spark, source)
    b, fb = _fs(spark, target)
    jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, conf)


def missing_files(spark: SparkSession, assets: list[tuple[str, str]]) -> dict[str, list[str]]:
    """Of (kind, path) those that are not there, by kind."""
    out: dict[str, list[str]] = {}
    for kind, path in assets:
        p, fs = _fs(spark, path)
        if not fs.exists(p):
            out.setdefault(kind, []).append(path)
    return out
