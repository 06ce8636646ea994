"""URL filters: listed host/path rules first, association rules of URL tokens for the rest. DataFrame and MLlib operations only.

Listed rules fit a host and its subdomains and a path prefix; the longest wins. Every other url is judged by rules that Spark's FP-growth
mines from labelled urls: a transaction is the set of a url's tokens and its label, and a rule is a token set that implies `block` or `allow`
with at least MIN_CONFIDENCE, a lift of at least MIN_LIFT and the support of the mining. A rule is pruned if a part of its tokens already is a
rule for the same verdict of at least its confidence. Matching goes through an inverted index from token to rules: a rule fires when the count
of its tokens found in a url equals its size; the most confident, then the best supported rule decides, and `allow` holds where none fires.

Tokens that every labelled url has cannot raise a confidence and are left out, and of tokens that occur in the very same labelled urls one
stands for all, so the itemsets do not double with each of them.

Labels: a page shows the document that the last number of its url's path names, and is labelled bad when that is labelled toxic or of low
quality.

Defined cases: null urls and urls without :// have an empty host and path and are allowed; null page_id is kept; repeated urls get equal
verdicts, and each labelled row of them counts in the mining; equal confidences and supports go by the rule's name; a very long url has its
tokens counted once each; empty pages give no rows; without labelled urls of both kinds no rules are mined and everything else is allowed;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame, functions as F

from .common import broadcast_if_small, join_salted, materialize

#: (verdict, host, path); fixed by the query's contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
MIN_SUPPORT = 0.001
#: Urls that must hold a token set before it counts, however few are labelled.
MIN_COUNT = 20
MIN_CONFIDENCE = 0.6
MIN_LIFT = 1.1
LABEL = "label="
SALTS = 32
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: F.Column) -> tuple[F.Column, F.Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _UPPER.lower()), path


def listed(host: F.Column, path: F.Column, rules=RULES) -> tuple[F.Column, F.Column]:
    """Name and verdict of the longest listed rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def tokens(url: F.Column) -> F.Column:
    """Distinct tokens of a url: scheme, the host's last two labels, words of its other labels, path words, shapes of numbers and query keys."""
    host, path = host_and_path(url)
    scheme = F.array(F.concat(F.lit("s:"), F.lower(F.substring_index(url, "://", 1))))
    site = F.substring_index(host, ".", -2)
    under = F.filter(F.split(F.substring(host, F.lit(1), F.length(host) - F.length(site)), r"[.-]+"), lambda x: x != "")
    words = F.transform(F.filter(F.split(F.lower(path), r"[/._~+-]+"), lambda x: x != ""), lambda x: F.concat(F.lit("p:"), F.regexp_replace(x, r"\d+", "0")))
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    mark = F.when(F.instr(url, "#") > 0, F.array(F.lit("f:"))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(scheme, F.array(F.concat(F.lit("d:"), site)), F.transform(under, lambda x: F.concat(F.lit("h:"), x)), words, keys, mark))


def document_of(url: F.Column) -> F.Column:
    """The document that a url names: the last number of its path, or null."""
    _, path = host_and_path(url)
    return F.nullif(F.regexp_extract(path, r"(?s)^.*/(\d{1,18})(?!\d)[^/]*/?$", 1), F.lit("")).cast("long")


def telling(rows: DataFrame) -> DataFrame:
    """Tokens of rows(id, items) to mine: not in all rows, and one (the least) for each set of rows that tokens occur in."""
    n = rows.count()
    each = rows.select("id", F.explode("items").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("id")).alias("x"), F.sum(F.xxhash64("id", F.lit(1)).cast("decimal(20,0)")).alias("s"))
    return each.where(F.col("k") < n).groupBy("k", "x", "s").agg(F.min("token").alias("token")).select("token")


RULE_SCHEMA = "rule long, items array<string>, verdict string, n int, confidence double, support double"


def mine(labelled: DataFrame) -> DataFrame:
    """(rule, items, verdict, n, confidence, support) of labelled(id, items, bad), id one for each row; redundant rules pruned."""
    spark = labelled.sparkSession
    rows = materialize(labelled.select("id", "items", "bad"), "url-labelled")
    kinds = {r["bad"]: r["count"] for r in rows.groupBy("bad").count().collect()}
    if set(kinds) != {True, False}:
        return spark.createDataFrame([], RULE_SCHEMA)
    kept = rows.select("id", "bad", F.explode("items").alias("token")).join(broadcast_if_small(materialize(telling(rows), "url-tokens")), "token").groupBy("id", "bad").agg(F.collect_list("token").alias("items"))
    baskets = materialize(kept.select(F.array_append("items", F.concat(F.lit(LABEL), F.when(F.col("bad"), "block").otherwise("allow"))).alias("items")), "url-transactions")
    # minSupport is a share of the baskets, and a url whose tokens all go has none.
    total, least = baskets.count(), max(MIN_SUPPORT * sum(kinds.values()), MIN_COUNT)
    if not total:
        return spark.createDataFrame([], RULE_SCHEMA)
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / total), minConfidence=MIN_CONFIDENCE).fit(baskets)
    share = F.when(F.col("consequent")[0] == LABEL + "block", kinds[True] / sum(kinds.values())).otherwise(kinds[False] / sum(kinds.values()))
    found = model.associationRules.where(F.col("consequent")[0].startswith(LABEL) & (F.col("confidence") >= MIN_LIFT * share))
    found = found.select(F.array_sort("antecedent").alias("items"), F.substring(F.col("consequent")[0], F.lit(len(LABEL) + 1), F.length(F.col("consequent")[0])).alias("verdict"), "confidence", "support")
    found = materialize(found.withColumns({"n": F.size("items"), "rule": F.xxhash64("items", "verdict")}), "url-rules")
    # Each rule is looked up under its rarest token, so a token that most rules share pairs few of them.
    each = found.select("rule", F.explode("items").alias("token"))
    rarest = each.join(each.groupBy("token").count(), "token").groupBy("rule").agg(F.min_by("token", F.struct("count", "token")).alias("token"))
    small = found.join(rarest, "rule").select("token", F.col("items").alias("part"), F.col("n").alias("m"), F.col("confidence").alias("c"), F.col("verdict").alias("v"))
    wider = each.join(found, "rule").join(small, "token").where((F.col("v") == F.col("verdict")) & (F.col("m") < F.col("n")) & (F.col("c") >= F.col("confidence")) & (F.size(F.array_except("part", "items")) == 0)).select("rule").distinct()
    parts = found.join(wider, "rule", "left_anti")
    return materialize(parts.select("rule", "items", "verdict", "n", "confidence", "support"), "url-rules-kept")


def match(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(key, fired, decided, confidence) for urls(key, url) on which a rule fires; the most confident, then the best supported rule decides.

    A url's tokens go by its key, which is short: a row for each token must not carry a url of any length.
    """
    index = materialize(rules.select(F.explode("items").alias("token"), "rule", "n", "confidence", "support", "verdict", F.array_join("items", " ").alias("fired")), "url-index")
    found = urls.select("key", F.explode(tokens(F.col("url"))).alias("token")).join(broadcast_if_small(index), "token")
    whole = found.groupBy("key", "rule").agg(F.count(F.lit(1)).alias("k"), *(F.first(c).alias(c) for c in ("n", "confidence", "support", "verdict", "fired"))).where("k = n")
    return whole.groupBy("key").agg(F.max(F.struct("confidence", "support", "fired", "verdict")).alias("top")).select("key", "top.fired", F.col("top.verdict").alias("decided"), "top.confidence")


def labelled_urls(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """(id, items, bad) of the pages whose document has a label."""
    bad = labels.groupBy("doc_id").agg(((F.max("toxic") == 1) | (F.min("quality") == 0)).alias("bad")).where("doc_id is not null and bad is not null")
    rows = pages.where("url is not null").select("url", document_of(F.col("url")).alias("doc_id")).join(bad, "doc_id")
    return rows.select(F.monotonically_increasing_id().alias("id"), tokens(F.col("url")).alias("items"), "bad")


def judge(pages: DataFrame, labels: DataFrame, listed_rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, fired (the association rule that decided, if any) and its confidence for each page."""
    host, path = host_and_path(F.col("url"))
    name, verdict = listed(host, path, listed_rules)
    rows = pages.select("page_id", "url", F.md5(F.col("url").cast("binary")).alias("key"), host.alias("host"), path.alias("path"), name.alias("rule"), verdict.alias("listed"))
    rules = mine(labelled_urls(pages, labels))
    # A fixed number of partitions: the urls are small, but each meets many rules, so they must not be put together in one task.
    parts = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    urls = rows.where("listed is null and url is not null").select("key", "url").repartition(parts, "key").dropDuplicates(["key"])
    out = join_salted(rows.drop("url"), match(urls, rules), "key", SALTS, F.coalesce(F.col("page_id"), F.lit(0)))
    free = F.col("listed").isNull()
    return out.select("page_id", "host", "path", "rule", F.coalesce(F.col("listed"), F.col("decided"), F.lit("allow")).alias("verdict"), F.when(free, F.col("fired")).alias("fired"), F.when(free, F.col("confidence")).alias("confidence"))
