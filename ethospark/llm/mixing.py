"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

A document's key is -ln(u) / w, u a hash of its id and w its quality weight; by ascending key a source's documents are a weighted sample
without replacement for every prefix. A source's target is met by complete epochs first, then by the prefix of its sorted documents
whose words fit; the last of these is taken in part. Targets are budget * weight / sum of weights, water-filled under max_epochs * size.

No source is sorted in one task: keys fall into buckets, bucket sums find the one bucket per source in which the prefix ends, and only
that bucket's rows are sorted.

Defined cases: null text has no words; null source is the last source; null doc_id hashes as "null"; unlabelled documents have the middle
weight; repeated rows count and are taken one by one; of equal keys the smaller doc_id, then the shorter text goes first; a text longer than
its source's target is taken in part; an empty table gives no rows; labels may repeat (the best quality counts); other columns are ignored by
`mix` and kept by `mixed_documents`, whatever their names, unless they start with two underscores. A document without words takes nothing of a
target; it is in the mix once, whatever its source's epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .common import broadcast_if_small, materialize

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = "mix-1"
#: Quality weights: labelled good, unlabelled, labelled poor. Their ratio bounds how uneven key buckets are.
GOOD, MIDDLE, POOR = 1.0, 0.75, 0.5
#: Buckets of keys of a source: so many at least, and one more for each ROWS_A_BUCKET rows of the table.
BUCKETS, ROWS_A_BUCKET = 512, 20_000
#: A word of the contract: a run of characters other than space and 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def annotate(docs: DataFrame, labels: DataFrame | None, seed: str = SEED, without: tuple[str, ...] = ()) -> DataFrame:
    """docs, less the columns `without`, with __size, __null, __src, __key and __bucket; bucket order follows key order.

    Columns in `without` are dropped before labels are joined, so texts need not move for it. The join is by sorting at every size.
    """
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    u = (F.conv(F.substring(h, 1, 12), 16, 10).cast("double") + 0.5) / 2.0**48
    out = docs.withColumns({"__size": F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long"), "__null": F.col("source").isNull(), "__src": F.coalesce(F.col("source"), F.lit("")), "__u": u}).drop(*without)
    weight = F.lit(MIDDLE)
    if labels is not None:
        quality = labels.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").alias("__q")).where("__id is not null")
        out = out.join(quality.hint("merge"), out["doc_id"] == F.col("__id"), "left")
        weight = F.when(F.col("__q") >= 1, GOOD).when(F.col("__q").isNotNull(), POOR).otherwise(MIDDLE)
    out = out.withColumn("__key", -F.log("__u") / weight)
    buckets = max(BUCKETS, docs.count() // ROWS_A_BUCKET)
    return out.withColumn("__bucket", F.floor(buckets * (1 - F.exp(-F.col("__key") * POOR)))).drop("__id", "__q", "__u")


def targets(sizes: DataFrame) -> DataFrame:
    """(__null, __src, source_size) -> with target; one row a source."""
    w = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod(F.row_number().over(Window.orderBy("__null", "__src")) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    s = sizes.withColumns({"w": w}).withColumn("cap", MAX_EPOCHS * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    order = Window.orderBy("ratio", "__null", "__src")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # The level at which a source is not above its cap, were all sources of smaller ratio at theirs; the largest that holds is the water level.
    s = s.withColumn("level", (SHARE * F.sum("source_size").over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after))
    s = s.withColumn("water", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(Window.partitionBy()))
    return s.select("__null", "__src", "source_size", F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("water"))).alias("target"))


def plan(rows: DataFrame) -> DataFrame:
    """Per source: __size_all, __target, complete __epochs, __rest (words of the last epoch), the bucket it __ends in and the words __before that bucket."""
    sums = materialize(rows.groupBy("__null", "__src", "__bucket").agg(F.sum("__size").alias("s")), "mix-buckets")
    t = targets(sums.groupBy("__null", "__src").agg(F.sum("s").alias("source_size")))
    t = t.select("__null", "__src", F.col("source_size").alias("__size_all"), F.col("target").alias("__target"))
    t = t.withColumn("__epochs", F.when(F.col("__size_all") > 0, F.floor(F.col("__target") / F.col("__size_all"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("__rest", F.floor(F.col("__target") - F.col("__epochs") * F.col("__size_all")).cast("long"))
    run = sums.withColumn("upto", F.sum("s").over(Window.partitionBy("__null", "__src").orderBy("__bucket")))
    ends = run.join(t, ["__null", "__src"]).where("__rest > 0 and upto >= __rest").groupBy("__null", "__src").agg(F.min("__bucket").alias("__ends"), F.min_by(F.col("upto") - F.col("s"), "__bucket").alias("__before"))
    return materialize(t.join(ends, ["__null", "__src"], "left"), "mix-plan")


def apply_plan(rows: DataFrame, by_source: DataFrame) -> DataFrame:
    """rows with the columns of plan and __last: words of the last, incomplete epoch."""
    rows = rows.join(broadcast_if_small(by_source), ["__null", "__src"])
    inside = Window.partitionBy("__null", "__src").orderBy("__key", "doc_id", "__size")
    ends = rows.where("__bucket = __ends").withColumn("__start", F.col("__before") + F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__size"))
    ends = ends.withColumn("__last", F.greatest(F.lit(0), F.least("__size", F.col("__rest") - F.col("__start")))).drop("__start")
    others = rows.where("__ends is null or __bucket <> __ends").withColumn("__last", F.when(F.col("__bucket") < F.col("__ends"), F.col("__size")).otherwise(F.lit(0)))
    return others.unionByName(ends)


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and source for each row of docs."""
    rows = materialize(annotate(docs.select("doc_id", "text", "source"), labels, seed, without=("text",)), "mix-rows")
    return apply_plan(rows, plan(rows)).select("doc_id", F.col("__size").alias("size"), F.col("__size_all").alias("source_size"), F.col("__target").alias("target"), (F.col("__epochs") * F.col("__size") + F.col("__last")).alias("taken"), "source")


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None, seed: str = SEED) -> DataFrame:
    """The mix itself, with the columns of docs: a document's row once for each epoch that takes it, the last one only if at least half of it fits; without words, once."""
    rows = annotate(docs, labels, seed)
    by_source = plan(rows)
    words = F.col("__epochs") + F.when(2 * F.col("__last") >= F.col("__size"), 1).otherwise(0)
    out = apply_plan(rows, by_source).withColumn("__copies", F.when(F.col("__size") > 0, words).otherwise(F.lit(1)).cast("int"))
    return out.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*(F.col(f"`{c}`") for c in docs.columns))
