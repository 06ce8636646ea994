"""Helpers that the training-data operators share: shared storage, checked broadcasts, salted joins, graph components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

#: A written side of at most this many rows and bytes of Parquet may be broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 50_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only where the session names none and runs on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        path = getattr(spark, "_llm_shared_dir", None) or "file://" + tempfile.mkdtemp(prefix="llm-shared-")
        spark._llm_shared_dir = path
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_table(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    jvm, spark = df.sparkSession._jvm, df.sparkSession
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written_bytes(df: DataFrame) -> int:
    """Size of the files of a materialized table."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f) for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}]
    return sum(p.getFileSystem(conf).getContentSummary(p).getLength() for p in paths)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a materialized table when its counted rows and its bytes are within bounds; otherwise leave the join to a shuffle, where AQE splits skew."""
    return F.broadcast(df) if df.count() <= limit and written_bytes(df) <= BROADCAST_BYTES else df


def first_by(h: F.Column, n: int, total: int) -> F.Column:
    """Whether a 64-bit hash is among the least 2 n + 200 or so of `total`, which surely holds the n least: tasks need not send their own n each."""
    share = min(1.0, (2 * n + 200) / max(1, total))
    return F.lit(True) if share >= 1 else h <= F.lit(int(-(2**63) + share * 2**64))


def join_salted(rows: DataFrame, keyed: DataFrame, key: str, salts: int, spread: F.Column) -> DataFrame:
    """Left join of rows with keyed (one row a key) where one key may hold a third of the rows.

    Rows of a key are spread over `salts` join keys by `spread`. keyed is repeated only for those salts that occur with a key,
    so a key of one row costs one row.
    """
    salted = rows.withColumn("__salt", F.pmod(F.xxhash64(spread), F.lit(salts)))
    there = salted.groupBy(key, "__salt").agg(F.lit(1).alias("__one")).select(key, "__salt")
    spread_out = there.join(keyed, key)
    return salted.join(spread_out, [key, "__salt"], "left").drop("__salt")


def bucket_rank(rows: DataFrame, part: list[str], bucket: str, order: list[str], out: str, total: str | None = None) -> DataFrame:
    """1-based row number of rows within part, by (bucket, order), without sorting a whole part in one task.

    bucket must follow order: a row of a smaller bucket sorts first. Counts of buckets give offsets; only a bucket's rows meet in a task.
    """
    counts = rows.groupBy(*part, bucket).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*part) if part else Window.partitionBy()
    offsets = counts.select(*part, bucket, F.coalesce(F.sum("__n").over(w.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"), *([F.sum("__n").over(w).alias(total)] if total else []))
    own = Window.partitionBy(*part, bucket).orderBy(*order)
    return rows.join(offsets, [*part, bucket]).withColumn(out, F.col("__off") + F.row_number().over(own)).drop("__off")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b) of longs: (node, comp), comp the least node; nodes without edges are absent.

    Alternates large-star and small-star (Kiveris et al., 2014). Each step is a grouped minimum and a join, so no neighbour list is ever
    collected; each round is written to the shared folder, and the rounds end when the edge set is a star forest.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    seen = None
    while True:
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, cur = cur, materialize(small.where("u <> v").distinct(), "cc")
        remove_table(last)
        now = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(cur.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
