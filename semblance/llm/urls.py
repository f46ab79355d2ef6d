"""URL filters: written rules first, then association rules mined from labelled pages.

Spark's FP-growth mines combinations of URL tokens that go with the label ``bad``. A rule must hold for MIN_COUNT bad rows
at least, so only tokens of so many bad rows are mined, and of tokens that stand in the same rows one
(a host and its labels, say). Rules are pruned by support, confidence and lift, and a rule is dropped if one with fewer tokens says the
same. To match, rules are indexed by their rarest token; the tokens of each distinct URL are
joined to that index and the whole combination is then held against the URL's tokens.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch
from .quality import LOWER, UPPER

#: (host, path, verdict); a rule fits its host and all subdomains, if the path starts with its path.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BAD = "label:bad"
MIN_SUPPORT, MIN_CONFIDENCE, MIN_LIFT = 0.003, 0.6, 1.5
#: Bad rows that a rule rests on, at least; mined tokens of one URL up to which FP-growth is used. Where a URL has more, combinations grow by levels, without a cap.
MIN_COUNT, WIDTH = 5, 10
#: A rule index of up to so many rules is broadcast; a larger one is joined by shuffle.
BROADCAST_RULES = 20_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or a URL without ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    """Distinct tokens of a URL, each with the part it stands in: scheme, host, host label, path word, query key; none of null or without ://."""
    host, path = host_and_path(url)
    split = lambda c, at, mark: F.transform(F.filter(F.split(c, at), lambda x: (x != "") & ~x.rlike("^[0-9]+$")), lambda x: F.concat(F.lit(mark), x))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1)))
    scheme = F.array(F.concat(F.lit("s:"), F.substring_index(F.coalesce(url, F.lit("")), "://", 1)))
    hosts = F.concat(split(host, r"\.", "h:"), F.array(F.concat(F.lit("H:"), host)))
    return F.when(F.instr(url, "://") > 0, F.array_distinct(F.concat(scheme, hosts, split(F.lower(path), r"[/._-]", "p:"), keys))).otherwise(F.array().cast("array<string>"))


def mined_tokens(rows: DataFrame, min_count: int) -> DataFrame:
    """(t, n) of rows(row, tokens, bad): tokens of min_count bad rows or more with their counts; of those in the same rows the least."""
    each = rows.select("row", "bad", F.explode("tokens").alias("t"))
    # two sums of hashes of the rows stand for their set
    sums = each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), *[F.sum(F.xxhash64(F.lit(k), "row").cast("decimal(20,0)")).alias(f"s{k}") for k in (1, 2)])
    return sums.where(F.col("n_bad") >= min_count).groupBy("n", "s1", "s2").agg(F.min("t").alias("t")).select("t", "n")


def wide_rules(rows: DataFrame, total, need: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rules (tokens, confidence, lift, support) and single tokens (t, freq) of rows(row, tokens, bad) of any width, by levels.

    What is sure already is not extended, nor what stands in the same rows as the shorter combination it comes from: a rule with fewer tokens says the same.
    """
    at = scratch.keep(rows.select("row", "bad", "tokens", F.explode("tokens").alias("t")).withColumn("x", F.array("t")).withColumn("n_from", F.lit(None).cast("bigint")))
    out, first = None, None
    while True:
        level = at.groupBy("x").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("n_bad"), F.min("n_from").alias("n_from"))
        level = scratch.keep(level.where((F.col("n_bad") >= need) & (F.col("n_from").isNull() | (F.col("n") < F.col("n_from")))).drop("n_from"))
        out, first = (level, level) if out is None else (out.unionByName(level), first)
        on = level.where("n_bad < n")
        if on.isEmpty():
            break
        kept = at.drop("n_from").join(on.select("x", F.col("n").alias("n_from")), "x")
        single = first.where("n_bad < n").select(F.col("x")[0].alias("next"))
        more = kept.select("row", "bad", "tokens", "x", "n_from", F.explode(F.filter("tokens", lambda t: t > F.element_at("x", -1))).alias("next")).join(single, "next")
        at = scratch.keep(more.select("row", "bad", "tokens", F.concat("x", F.array("next")).alias("x"), "n_from"))
    sure = F.col("n_bad") / F.col("n")
    rules = out.select(F.col("x").alias("tokens"), sure.alias("confidence"), (sure / (total["bad"] / total["n"])).alias("lift"), (F.col("n_bad") / total["n"]).alias("support"))
    return rules, first.select(F.col("x")[0].alias("t"), F.col("n").alias("freq"))


def mine(labelled: DataFrame, scratch: Scratch, *, min_support=MIN_SUPPORT, min_confidence=MIN_CONFIDENCE, min_lift=MIN_LIFT, min_count=MIN_COUNT) -> DataFrame:
    """Rules (tokens, confidence, support, key) from labelled(url, bad); key is the rarest token.

    No labelled rows, or fewer bad ones than min_count, give no rules. Rows with null url or label don't count; repeated rows count each;
    URLs without :// have no tokens but count as rows.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "tokens array<string>, confidence double, support double, key string")
    rows = labelled.where("url is not null and bad is not null").select(F.monotonically_increasing_id().alias("row"), url_tokens(F.col("url")).alias("tokens"), "bad")
    rows = scratch.keep(rows)
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("bad")).first()
    if total["bad"] < min_count:
        return none
    known = scratch.keep(mined_tokens(rows, min_count))
    kept = rows.select("row", F.explode("tokens").alias("t")).join(known, "t").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("n", "t"))).alias("x"))
    kept = scratch.keep(kept)
    if kept.where(F.size("x") > WIDTH).isEmpty():
        items = F.transform(F.coalesce("x", F.array().cast("array<struct<n:bigint,t:string>>")), lambda x: x["t"])
        # every row counts for the support, those without a mined token too
        rows = scratch.keep(rows.select("row", "bad").join(kept, "row", "left").select(F.concat(items, F.when(F.col("bad"), F.array(F.lit(BAD))).otherwise(F.array().cast("array<string>"))).alias("items")))
        model = FPGrowth(itemsCol="items", minSupport=max(min_support, min_count / total["n"]), minConfidence=min_confidence).fit(rows)
        rules = model.associationRules.where((F.size("consequent") == 1) & F.array_contains("consequent", BAD)).withColumnRenamed("antecedent", "tokens")
        single = model.freqItemsets.where(F.size("items") == 1).select(F.get("items", F.lit(0)).alias("t"), "freq")
    else:
        need = math.ceil(max(min_support, min_count / total["n"]) * total["n"])
        rules, single = wide_rules(rows.select("row", "bad").join(kept.select("row", F.transform("x", lambda x: x["t"]).alias("tokens")), "row"), total, need, scratch)
        rules = rules.where(F.col("confidence") >= min_confidence)
    rules = rules.where(F.col("lift") >= min_lift).select(F.array_sort("tokens").alias("tokens"), "confidence", "support").cache()
    try:
        if rules.isEmpty():
            return none
        key = rules.select("tokens", F.explode("tokens").alias("t")).join(single, "t").groupBy("tokens").agg(F.min_by("t", F.struct("freq", "t")).alias("key"))
        # by the key of the shorter rule, so that only rules that share a token meet
        short = rules.join(key, "tokens").select(F.col("tokens").alias("few"), F.col("confidence").alias("as_sure"), "key")
        longer = rules.select("tokens", "confidence", F.explode("tokens").alias("key")).join(short, "key")
        said = longer.where((F.size("few") < F.size("tokens")) & (F.col("as_sure") >= F.col("confidence")) & (F.size(F.array_except("few", "tokens")) == 0)).select("tokens").distinct()
        out = rules.join(key, "tokens").join(said, "tokens", "left_anti").select("tokens", "confidence", "support", "key")
        # counted first: so many are kept as a local table, more are written
        if rules.count() <= BROADCAST_RULES:
            return spark.createDataFrame(out.collect(), none.schema)
        return scratch.keep(out)
    finally:
        rules.unpersist()


def matched(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct urls that some rule's tokens all stand in. Null urls, those without :// and an empty table of rules have no match; a URL of any length is held once."""
    index = rules.select("key", "tokens")
    if rules.limit(BROADCAST_RULES + 1).count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    has = urls.where("url is not null").select("url").distinct().withColumn("have", url_tokens(F.col("url")))
    hits = has.select("url", "have", F.explode("have").alias("key")).join(index, "key").where(F.size(F.array_except("tokens", "have")) == 0)
    return hits.select("url").distinct()


def judge(pages: DataFrame, rules: DataFrame, *, id_col="page_id", url_col="url", written=RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict.

    The longest written rule that fits decides; else mined rules block, and what none
    matches is allowed. Null URLs and URLs without :// have no host, path, tokens or rule: allowed.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = rows.withColumn("host", host).withColumn("path", path)
    rule, verdict = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), F.lit(None).cast("string"))
    for h, p, v in sorted(written, key=lambda r: -len(r[0] + r[1])):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = rule.when(fits, F.lit(h + p)), verdict.when(fits, F.lit(v))
    hit = matched(rows, rules).select(F.col("url").alias("hit"))
    rows = rows.withColumn("rule", rule).withColumn("said", verdict).join(hit, F.col("url") == F.col("hit"), "left")
    return rows.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("hit").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a page are those of the document with its id; quality 0 counts as bad."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))
    return judge(pages, mine(pages.join(labels, "page_id").select("url", "bad"), Scratch(spark, "op9")))
