"""Quality rules with host verdicts.

Each document is measured and put to rules. Failures are counted by host; a host's failure
rate is shrunk towards all hosts' mean by a beta prior fitted to them, so that a host with few
documents is judged by the prior and one with many by its own rate. Documents of a host whose
shrunken rate is too high go, and so do documents that fail a rule themselves.

Native throughout: arrays of word hashes inside one row, no shuffle of texts or words. A
document's arrays are bounded by its own length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetwatch.llm.text import words
from fleetwatch.plans.cut import cut

WINDOW = 8
SYMBOLS = "[^#*$%&|<>]+"


@dataclass(frozen=True)
class RuleLimits:
    """Limits of the rules; shares in percent."""

    min_words: int = 20
    repeat_words: int = 30
    symbols_per_word: int = 10
    dup_lines: int = 50
    stutter: int = 30
    capital_letters: int = 60
    min_mean_word: float = 2.0
    max_mean_word: float = 25.0
    #: A host goes when its shrunken failure rate is at least this.
    host_rate: float = 0.5


def _pairs(hashes: str, apart: int) -> Column:
    """Hashes of each item with the one `apart` places on: n - apart of them."""
    left, right = F.expr(f"slice({hashes}, 1, greatest(size({hashes}) - {apart}, 0))"), F.expr(f"slice({hashes}, {apart + 1}, greatest(size({hashes}) - {apart}, 0))")
    return F.zip_with(left, right, lambda a, b: F.xxhash64(a, b))


def measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stutter, n_lines, n_letters, n_capitals (long) to `docs`.

    Words are runs of anything but space and \\t to \\r; a null text has none. Lines are split
    at \\n and count if they hold a word; a duplicate line equals an earlier one. Repeated words
    are those inside 8-word windows that occur at least twice in the text, the first included;
    a word stutters if it equals the word before.
    Columns of `docs` with these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in docs.columns if c not in {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_lines", "n_letters", "n_capitals"}]
    one = docs.select(
        *kept, words(text).alias("_w"), lines.alias("_l"), F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace(text, SYMBOLS, "")).cast("long").alias("n_symbols"), F.length(F.regexp_replace(text, r"\P{L}+", "")).cast("long").alias("n_letters"),
        F.length(F.regexp_replace(text, r"\P{Lu}+", "")).cast("long").alias("n_capitals"))
    two = one.select(*kept, "word_chars", "n_symbols", "n_letters", "n_capitals", F.size("_w").cast("long").alias("n_words"), F.size("_l").cast("long").alias("n_lines"),
                     (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"), F.transform("_w", lambda x: F.xxhash64(x)).alias("_h1"))
    same = F.filter(F.zip_with(F.expr("slice(_h1, 2, greatest(size(_h1) - 1, 0))"), F.expr("slice(_h1, 1, greatest(size(_h1) - 1, 0))"), lambda a, b: a == b), lambda x: x)
    two = two.withColumn("n_stutter", F.size(same).cast("long"))
    rest = [c for c in two.columns if c != "_h1"]
    # Windows of 2, 4 and 8 words: each hash joins two of the size before.
    wide = two.select(*rest, _pairs("_h1", 1).alias("_h2"))
    wide = wide.select(*rest, _pairs("_h2", 2).alias("_h4"))
    wide = wide.select(*rest, _pairs("_h4", 4).alias("_h8"))
    some = F.size(F.array_distinct("_h8")) < F.size("_h8")
    marked = F.when(some, F.sort_array(F.transform("_h8", lambda x, i: F.struct(x.alias("h"), i.alias("i")))))
    sorted_ = wide.select(*rest, marked.alias("_s"))
    near = F.zip_with("_s", F.expr("slice(_s, 2, size(_s) - 1)"), lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False)))
    sorted_ = sorted_.select(*rest, "_s", near.alias("_n"))
    # A window recurs if it equals its neighbour on either side in the order of hashes.
    both = F.zip_with("_n", F.expr("concat(array(false), slice(_n, 1, size(_n) - 1))"), lambda a, b: a | b)
    sorted_ = sorted_.select(*rest, "_s", both.alias("_n"))
    at = F.sort_array(F.filter(F.zip_with("_s", "_n", lambda s, n: F.when(n, s["i"])), lambda x: x.isNotNull()))
    sorted_ = sorted_.select(*rest, at.alias("_p"))
    covered = F.zip_with("_p", F.expr("slice(_p, 2, size(_p) - 1)"), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    return sorted_.select(*rest, F.coalesce(F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"))


def failures(limits: RuleLimits) -> dict[str, Column]:
    """The rules, true where a document fails; on the columns of `measures`."""
    n, c = F.col("n_words"), F.col
    return {
        "few_words": n < limits.min_words,
        "repetition": 100 * c("n_repeat_words") > limits.repeat_words * n,
        "symbols": 100 * c("n_symbols") > limits.symbols_per_word * n,
        "dup_lines": 100 * c("n_dup_lines") > limits.dup_lines * c("n_lines"),
        "stutter": 100 * c("n_stutter") > limits.stutter * n,
        "capitals": 100 * c("n_capitals") > limits.capital_letters * c("n_letters"),
        "word_length": (c("word_chars") < limits.min_mean_word * n) | (c("word_chars") > limits.max_mean_word * n),
    }


def host_table(measured: DataFrame, limits: RuleLimits) -> DataFrame:
    """Counts and verdict of each host: host, n_docs, n_failed, shrunk_rate, blocked.

    The prior's mean is the rate of all documents, its strength follows from the spread of the
    hosts' rates by the method of moments; when they spread no more than chance would
    make them, every host gets the mean.
    """
    hosts = cut(measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")))
    rate = F.col("n_failed") / F.col("n_docs")
    whole = hosts.agg(F.sum("n_docs").alias("n"), F.sum("n_failed").alias("f"), F.count("*").alias("k"), F.sum(F.col("n_docs") * F.col("n_docs")).alias("nn"), F.sum(F.col("n_docs") * rate * rate).alias("rr")).first()
    n, f, k = float(whole["n"] or 0), float(whole["f"] or 0), int(whole["k"])
    mean = f / n if n else 0.0
    # Between-host variance of a beta-binomial: weighted spread less what sampling alone gives.
    spread = (float(whole["rr"] or 0) / n - mean * mean) if n else 0.0
    size = (n - float(whole["nn"] or 0) / n) if n else 0.0
    between = max(0.0, (n * spread - (k - 1) * mean * (1 - mean)) / size) if size > 0 else 0.0
    strength = max(1.0, mean * (1 - mean) / between - 1) if between > 0 else 1e9
    shrunk = (F.col("n_failed") + F.lit(mean * strength)) / (F.col("n_docs") + F.lit(strength))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("blocked", F.col("shrunk_rate") >= limits.host_rate)


def judge(docs: DataFrame, host: str = "source", limits: RuleLimits = RuleLimits()) -> DataFrame:
    """doc_id, host, the measures, base_failed, failed_rules, shrunk_rate and kept, a row for each of `docs`.

    `host`: the column that names a document's host. A document with a null host is judged by
    its own rules only. base_failed: few words or repetition. kept: no rule failed and the
    host not blocked. Repeated rows get a row each; an empty table gives an empty one.
    """
    rules = failures(limits)
    lists = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]), lambda x: x.isNotNull())
    chosen = docs.select(F.col("doc_id"), F.col(host).cast("string").alias("host"), "text")
    measured = measures(chosen).drop("text").withColumn("base_failed", rules["few_words"] | rules["repetition"]).withColumn("failed_rules", lists)
    measured = cut(measured.withColumn("failed", F.size("failed_rules") > 0))
    # Written first: its measured size decides whether it is broadcast; else both sides are dealt out by host, and hot hosts split.
    verdicts = cut(host_table(measured, limits).select("host", "shrunk_rate", "blocked"))
    return measured.join(verdicts, "host", "left").withColumn("kept", ~F.col("failed") & ~F.coalesce("blocked", F.lit(False))).drop("failed", "blocked")


def keep_good(docs: DataFrame, host: str = "source", limits: RuleLimits = RuleLimits()) -> DataFrame:
    """The rows of `docs` that `judge` keeps, with the columns of `docs`.

    Verdicts on a row don't depend on its id, so the measures are taken twice rather than
    the texts written: once for the hosts, once for the rows.
    """
    any_failed = None
    for rule in failures(limits).values():
        any_failed = rule if any_failed is None else any_failed | rule
    names = docs.columns
    plain = docs.select(F.struct(*names).alias("_row"), F.col(host).cast("string").alias("host"), "text")
    measured = measures(plain).withColumn("failed", any_failed)
    verdicts = cut(host_table(measured.select("host", "failed"), limits).where("blocked").select("host"))
    # The row number keeps the filter above the measures: pushed below, it would repeat each of them at every use.
    fine = measured.withColumn("_at", F.monotonically_increasing_id()).where(~F.col("failed") & (F.col("_at") >= 0))
    return fine.join(verdicts, "host", "left_anti").select("_row.*")
