"""URL verdicts: a list of host and path rules first, mined association rules for the rest.

URLs become sets of tokens (scheme, host, registered name, labels, path words, file ending,
query keys). Token sets that fit enough bad URLs are grown level by level; those with enough
confidence, and none that a shorter rule already covers, are kept. Each rule is listed
under its rarest token; a URL looks up its tokens in that inverted index and the few rules
found are compared with all its tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.plans.cut import cut

#: (verdict, host and path). A rule fits its host and all subdomains, if the path starts with the rule's.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class MiningLimits:
    """`least`: bad URLs that a rule must fit, however many are labelled; `confidence`: least share of bad ones among all it fits."""

    least: int = 25
    confidence: float = 0.6


def parts(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL; both empty for null or without `://`."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    got = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(got, pattern, 1), UPPER, LOWER), F.regexp_extract(got, pattern, 2)


def listed(host: Column, path: Column, rules: list[tuple[str, str]] = RULES) -> Column:
    """The longest fitting rule of a list as struct(rule, verdict), null if none fits. Ties go to the first in order of text."""
    table = F.array(*[F.struct(F.lit(-len(r)).alias("n"), F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r[: r.index("/")]).alias("host"), F.lit(r[r.index("/") :]).alias("path")) for v, r in rules])
    fits = F.filter(table, lambda x: ((host == x["host"]) | host.endswith(F.concat(F.lit("."), x["host"]))) & path.startswith(x["path"]))
    best = F.array_min(fits)
    return F.when(best.isNotNull(), F.struct(best["rule"].alias("rule"), best["verdict"].alias("verdict")))


def tokens(url: Column) -> Column:
    """Distinct tokens of a URL; none for null or without `://`. Numbers in paths count as one token."""
    host, path = parts(url)
    got = F.coalesce(url, F.lit(""))
    labels = F.split(host, r"\.")
    words = F.filter(F.split(F.regexp_replace(path, r"\.[A-Za-z0-9]{1,5}$", ""), r"[/_\-.]+"), lambda x: x != "")
    ending = F.regexp_extract(path, r"(\.[A-Za-z0-9]{1,5})$", 1)
    keys = F.regexp_extract_all(F.regexp_extract(got, r"(?s)^[^#]*?\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), F.lit(1))
    every = F.concat(
        F.array(F.concat(F.lit("scheme:"), F.lower(F.regexp_extract(got, r"(?s)^(.*?)://", 1))), F.concat(F.lit("host:"), host), F.concat(F.lit("name:"), F.concat_ws(".", F.slice(labels, F.greatest(F.size(labels) - 1, F.lit(1)), 2)))),
        F.transform(F.filter(labels, lambda x: x != ""), lambda x: F.concat(F.lit("part:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("path:"), F.when(x.rlike(r"^\d+$"), "#").otherwise(F.lower(x)))),
        F.when(ending != "", F.array(F.concat(F.lit("end:"), F.lower(ending)))).otherwise(F.array().cast("array<string>")),
        F.transform(keys, lambda x: F.concat(F.lit("key:"), F.lower(x))))
    return F.when(got.contains("://"), F.array_distinct(every)).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, limits: MiningLimits = MiningLimits()) -> DataFrame:
    """Rules from labelled URLs (url, bad boolean): items, confidence, support, first (the rarest item).

    Token sets grow by a token a level, as long as there are any. A set that is a rule grows no
    further, as the rule covers all larger ones; neither does one of which a token can go without
    a URL more fitting it, as what is left grows in its place. Rows with a null label take no
    part. Nothing to learn from, or no rule good enough: no rows.
    """
    url = F.col("url")
    rows = labelled.where("bad IS NOT NULL").select(F.array_sort(tokens(url)).alias("items"), F.col("bad").cast("long").alias("bad"))
    rows = cut(rows.groupBy("items").agg(F.count("*").alias("n"), F.sum("bad").alias("bad")).withColumn("row", F.monotonically_increasing_id()))
    total = rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    held = rows.select("row", "n", "bad", F.explode("items").alias("item")).select("row", "n", "bad", F.array("item").alias("items"))
    rules, live, counts, size = [], None, None, 1
    while True:
        found = held.groupBy("items").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")).where(F.col("bad") >= limits.least)
        if live is None:
            found = found.withColumn("wider", F.lit(total))
        else:  # all sets of a token less have to be alive
            less = F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.concat(F.slice("items", 1, i - 1), F.slice("items", i + 1, size)))
            parts_of = found.select("*", F.explode(less).alias("less")).join(live.select(F.col("items").alias("less"), F.col("n").alias("wider")), "less")
            found = parts_of.groupBy("items", "n", "bad").agg(F.min("wider").alias("wider"), F.count("*").alias("k")).where(F.col("k") == size).drop("k")
        found = cut(found.withColumn("rule", F.col("bad") / F.col("n") >= limits.confidence))
        counts = found.select(F.col("items")[0].alias("item"), "n") if counts is None else counts
        rules.append(found.where("rule"))
        live = found.where("NOT rule AND n < wider")
        if live.isEmpty():
            break
        held = cut(held.join(live.select("items"), "items"))
        # Two sets of a row that differ in their last token only make one of the next level.
        ends = held.groupBy("row", "n", "bad", F.slice("items", 1, size - 1).alias("head")).agg(F.sort_array(F.collect_list(F.element_at("items", -1))).alias("ends"))
        pairs = ends.select("row", "n", "bad", "head", "ends", F.posexplode("ends").alias("at", "one")).select("row", "n", "bad", "head", "one", F.explode(F.slice("ends", F.col("at") + 2, F.size("ends"))).alias("two"))
        held = pairs.select("row", "n", "bad", F.concat("head", F.array("one", "two")).alias("items"))
        size += 1
    found = reduce(DataFrame.union, rules)
    rarest = found.select("items", F.explode("items").alias("item")).join(counts, "item").groupBy("items").agg(F.min_by("item", F.struct("n", "item")).alias("first"))
    return cut(found.join(rarest, "items").select("items", (F.col("bad") / F.col("n")).alias("confidence"), (F.col("bad") / F.lit(max(total, 1))).alias("support"), "first"))


def matched(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """page_id, url and the surest rule (mined_rule, confidence) of those pages that a mined rule fits."""
    rows = pages.select("page_id", "url").distinct().withColumn("tokens", tokens(F.col("url")))
    found = rows.withColumn("first", F.explode("tokens")).join(rules, "first").where(F.size(F.array_except("items", "tokens")) == 0)
    best = F.max(F.struct("confidence", F.concat_ws(" ", "items").alias("mined_rule")))
    return found.groupBy("page_id", "url").agg(best.alias("_best")).select("page_id", "url", "_best.mined_rule", "_best.confidence")


def judge_urls(pages: DataFrame, labelled: DataFrame, rules: list[tuple[str, str]] = RULES, limits: MiningLimits = MiningLimits()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined_rule, confidence for each of `pages`.

    The longest listed rule that fits decides; else a page that a mined rule fits is blocked,
    any other allowed. Repeated rows, null ids and null URLs get a row each. Columns of
    `pages` other than page_id and url aren't used.
    """
    host, path = parts(F.col("url"))
    judged = pages.select("page_id", "url", host.alias("host"), path.alias("path")).withColumn("_l", listed(F.col("host"), F.col("path"), rules))
    hits = cut(matched(pages, mine(labelled, limits))).withColumnsRenamed({"page_id": "_page", "url": "_url"})
    joined = judged.join(hits, judged["page_id"].eqNullSafe(hits["_page"]) & judged["url"].eqNullSafe(hits["_url"]), "left")
    verdict = F.coalesce(F.col("_l.verdict"), F.when(F.col("confidence").isNotNull(), "block").otherwise("allow"))
    return joined.select("page_id", "host", "path", F.col("_l.rule").alias("rule"), verdict.alias("verdict"), "mined_rule", "confidence")
