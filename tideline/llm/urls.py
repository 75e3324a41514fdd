"""URL filtering by pattern rules, each indexed by its rarest literal token, in DataFrame operations only.

A rule names a host and the start of a path.  The host's labels and the closed segments of the path are literal tokens that
every URL it fits must hold.  Each rule is filed under the token that fewest URLs hold; a URL's tokens fetch its
candidate rules, and only those run their regular expression.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.scratch import materialize

RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: The verdict where no rule fits.
DEFAULT = "allow"
#: Up to so many rules go to every task (some 20 MB); more are joined by shuffles, where Spark splits frequent tokens.
BROADCAST_RULES = 50_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def _tokens(host: Column, path: Column) -> Column:
    """Labels of the host and segments of the path that a / closes, apart by a first character, and the token of every URL."""
    closed = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    labels = F.filter(F.split(host, r"\."), lambda t: t != "")
    return F.array_distinct(F.concat(F.array(F.lit("")), F.transform(labels, lambda t: F.concat(F.lit("."), t)), F.transform(F.filter(closed, lambda t: t != ""), lambda t: F.concat(F.lit("/"), t))))


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """(rule, action, pattern, tokens) of (action, host/path) pairs; a rule without a slash holds for all paths."""
    listed = json.dumps([{"action": action, "rule": rule} for action, rule in rules])  # one literal, however many there are
    given = spark.range(1).select(F.inline(F.from_json(F.lit(listed), "array<struct<action:string,rule:string>>")))
    host, path = F.substring_index("rule", "/", 1), F.regexp_replace("rule", "(?s)^[^/]*", "")
    host = F.translate(host, _UPPER, _LOWER)
    quote = lambda c: F.regexp_replace(c, r"([\\\.\[\]\{\}\(\)\*\+\-\?\^\$\|/])", r"\\$1")
    anywhere = F.when(host == "", F.lit(r"(?s)^[^/]*")).otherwise(F.concat(F.lit(r"(?s)^(?:[^/]*\.)?"), quote(host)))
    pattern = F.concat(anywhere, quote(path))
    pattern = F.when(path == "", F.concat(pattern, F.lit("(?:/.*)?$"))).otherwise(pattern)
    return given.select("rule", "action", pattern.alias("pattern"), _tokens(host, path).alias("tokens"))


def rule_index(urls: DataFrame, rules: DataFrame, near=F.broadcast) -> DataFrame:
    """(token, rule, action, pattern): each rule under its rarest token among ``urls(tokens)``, ties to the longer token.

    ``near`` is ``F.broadcast`` where the number of rules is known to be small.
    """
    wanted = rules.select("rule", "action", "pattern", F.explode("tokens").alias("token"))
    held = urls.select(F.explode("tokens").alias("token")).join(near(wanted.select("token").distinct()), "token", "left_semi").groupBy("token").agg(F.count("*").alias("urls"))
    rarest = F.min_by("token", F.struct(F.coalesce("urls", F.lit(0)), -F.length("token"), "token"))
    return wanted.join(held, "token", "left").groupBy("rule", "action", "pattern").agg(rarest.alias("token"))


def filter_urls(pages: DataFrame, rules=RULES, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule and verdict of every row of ``pages(page_id, url)``.

    Of the rules that fit, the longest wins (of equal length: block before allow, then the greater rule); the rule's action
    is the verdict, ``default`` where none fits.  A null URL or one without :// has an empty host and path, which no
    rule with a host fits.  Repeated rows are judged one by one; other columns are not read; no rows give no rows.
    """
    url = F.col("url").cast("string")
    own = materialize(pages.select(F.monotonically_increasing_id().alias("row"), "page_id", host_of(url).alias("host"), path_of(url).alias("path")), "urls")
    tokens = own.select("row", "host", "path", _tokens(F.col("host"), F.col("path")).alias("tokens"))
    near = F.broadcast if len(rules) <= BROADCAST_RULES else lambda df: df
    index = near(rule_index(tokens, rule_table(pages.sparkSession, rules), near))
    candidates = tokens.select("row", "host", "path", F.explode("tokens").alias("token")).join(index, "token")
    fits = candidates.where(F.expr("concat(host, path) rlike pattern"))
    rank = F.struct(F.length("rule"), F.when(F.col("action") == "block", 1).otherwise(0), F.col("rule"))
    best = fits.groupBy("row").agg(F.max_by(F.struct("rule", "action"), rank).alias("best"))
    return own.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))
