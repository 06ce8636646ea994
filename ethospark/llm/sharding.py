"""Proportional stratified interleaving: shards that all hold the mixture of the whole.

Rows are shuffled by a seeded hash within their source and ranked; a row's fractional rank (rank - 1/2) / rows of its source spreads
every source evenly over (0, 1). Sorted by it and cut into equal runs, each shard gets each source's share, and counts differ by one at most
(law `rows`).

Defined cases: null text counts as empty; null source is a source of its own; null doc_id hashes as the text "null"; repeated rows take
places of their own (equal hashes go by checksum and size of the text); a text of any length is one row, as only its size and checksum move; an empty table gives no rows; other columns are ignored. Equal texts are not held together: the law is `rows`, and a
group of copies may be larger than a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import bucket_rank, materialize

N_SHARDS = 40
SEED = "interleave-1"
#: Buckets of a source and of the whole: so many at least, and one for each ROWS_A_BUCKET rows.
BUCKETS, ROWS_A_BUCKET = 64, 5_000


def interleave(docs: DataFrame, n_shards: int = N_SHARDS, seed: str = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and source for each row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), "source", F.col("source").isNull().alias("src_null"), F.coalesce("source", F.lit("")).alias("src"), h.alias("h"))
    rows = materialize(rows, "shard-rows")
    n = rows.count()
    buckets = max(BUCKETS, n // ROWS_A_BUCKET)
    rows = rows.withColumn("b1", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("double") / 2.0**32 * buckets))
    rows = bucket_rank(rows, ["src_null", "src"], "b1", ["h", "text_crc32", "size"], "r", "n_src")
    rows = rows.withColumn("f", (F.col("r") - 0.5) / F.col("n_src")).withColumn("b2", F.floor(F.col("f") * buckets))
    rows = bucket_rank(rows, [], "b2", ["f", "src_null", "src"], "g")
    rows = rows.withColumn("g", F.col("g") - 1).withColumn("shard", F.expr(f"(g * {n_shards}L) div {max(n, 1)}L"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), F.expr(f"g - (shard * {n}L + {n_shards - 1}L) div {n_shards}L").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "source")
