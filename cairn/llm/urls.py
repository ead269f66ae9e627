"""URL filters: rules first, then a ratio of character language models; DataFrame functions only.

Hosts and paths are cut by pattern.  A rule (host, path) fits its host and all subdomains if the URL's path starts with
the rule's; the longest that fits decides.  URLs that no rule fits are judged by two smoothed Markov models of variable
order, of the accepted and of the rejected URLs: a URL is blocked if its log-likelihood ratio, divided by its length,
falls below a threshold that was calibrated on URLs of both classes which the models have not seen: it gives up at most
``GIVEN_UP`` of the accepted ones, and blocks nothing if the models don't tell the classes apart.  What rules look at is
taken out of URLs before the models see them, so that they learn what else the classes differ in, not the rules again.

Null URLs, and ones without ``://``, have an empty host and path and fit no rule; null and empty URLs score 0, which is
never blocked.  Without labelled URLs of either class nothing is blocked.  Repeated rows are judged alike, very long URLs
by all their characters; an empty table gives an empty one; other columns of the table, whatever their names, are not read.
"""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from cairn.llm import markov

#: Letters and signs that have a code of their own; digits share one. Anything else shares the last.
ALPHABET = string.ascii_lowercase + "0./-_?=&%#:"
#: Share of held-out accepted URLs that the threshold gives up.
GIVEN_UP = 0.01
#: The URLs of one host in so many are held out of the models.
FOLDS = 5
#: Stands for what rules name: a sign that shares the last code. Width of a bin of scores; a threshold that blocks nothing.
MASK, BIN, NEVER = "~", 1000, -(1 << 62)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, both null if none fits. ``rules``: (verdict, host and path)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def without_rules(url: Column, rules: list[tuple[str, str]]) -> Column:
    """``url`` with a sign in the place of each host label and path segment that a rule names: rules answer for those."""
    names = sorted({part for _, rule in rules for part in re.split("[./]", rule.lower()) if part})
    return F.regexp_replace(url, "(?<![a-z0-9_-])(?:" + "|".join(map(re.escape, names)) + ")(?![a-z0-9_-])", MASK) if names else url


def url_grams(url: Column, rules: list[tuple[str, str]] = ()) -> Column:
    plain = F.regexp_replace(without_rules(F.lower(F.coalesce(url, F.lit(""))), rules), "[0-9]", "0")
    return markov.let(markov.codes(plain, ALPHABET), lambda c: markov.grams(c, markov.size_of(ALPHABET)))


def threshold(scores: DataFrame) -> tuple[int, float, float]:
    """The greatest score below which URLs are blocked, and the shares of accepted and rejected ones of ``scores`` (score,
    label) that it blocks: no more of the accepted than ``GIVEN_UP``, and fewer of them than of the rejected.

    Scores are counted by thousandths of a nat, whose number has a bound, so nothing else meets in one task.
    """
    bins = scores.groupBy(F.expr(f"score div {BIN} - IF(score % {BIN} < 0, 1, 0)").alias("bin")).agg(F.count_if("label").alias("yes"), F.count_if(~F.col("label")).alias("no"))
    none = scores.sparkSession.range(1).selectExpr("-1L AS bin", "0L AS yes", "0L AS no")  # the threshold 0 is one to choose
    bins = bins.unionByName(none).groupBy("bin").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    up_to = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    share = lambda c: F.sum(c).over(up_to) / F.greatest(F.sum(c).over(Window.partitionBy()), F.lit(1))
    fits = bins.select("bin", share("yes").alias("lost"), share("no").alias("caught")).where((F.col("bin") < 0) & (F.col("lost") <= GIVEN_UP) & (F.col("lost") < F.col("caught")))
    best = fits.orderBy(F.desc("bin")).first()
    return ((best["bin"] + 1) * BIN, best["lost"], best["caught"]) if best else (NEVER, 0.0, 0.0)


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict, score (millionths of a nat a character) and threshold of ``pages`` (page_id, url).

    ``rules`` is a list of a few hundred at most; it becomes part of the plan.  ``labelled`` (url, accepted) trains and
    calibrates the models; by default all pages that rules decide do.
    """
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    cut = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = cut.select("page_id", "url", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    if labelled is None:
        labelled = ruled.where("ruled IS NOT NULL").select("url", (F.col("ruled") == "allow").alias("accepted"))
    held_out = F.pmod(F.xxhash64(host_of(F.col("url"))), F.lit(FOLDS)) == 0
    samples = labelled.where("url <> '' AND accepted IS NOT NULL").select(url_grams(F.col("url"), rules).alias("grams"), F.col("accepted").alias("label"), held_out.alias("held_out"))
    weights = markov.as_value(markov.train(samples.where(~F.col("held_out")), markov.size_of(ALPHABET)))
    limit, _, _ = threshold(samples.where("held_out").select(markov.ratio(F.col("grams"), weights).alias("score"), "label"))
    scored = ruled.select("*", markov.ratio(url_grams(F.col("url"), rules), weights).alias("score"))
    judged = F.coalesce("ruled", F.when(F.col("score") < limit, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score", F.lit(limit).cast("long").alias("threshold"))
