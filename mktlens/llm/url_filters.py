"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over host and path, with the literal tokens (whole
runs of a-z and 0-9, bounded on both sides) that any match must hold. Each rule is indexed under the one of its
tokens that is rarest over all URLs; a URL fetches the rules of its own tokens by
an equi-join, and only those run their expressions; a rule without such a token runs
on every URL. Host rules (host and all its
subdomains, path by prefix) win over the method's rules, the longest first; among
the others the longest pattern wins. A URL that nothing fits is allowed.

Cases: a null URL, or one without ``://``, has empty host and path, and only the
default verdict; repeated rows and ids are kept, each with its verdict; further
columns are ignored; an empty table gives an empty table; URLs of any length are
taken whole (a URL asks for each distinct token once).
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Host rules, (action, host, path).
HOST_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
#: The method's rules, (action, regular expression over lower-cased host and path, literal tokens).
PATTERN_RULES = [
    ("block", r"(^|[./-])casino[./-]", ("casino",)),
    ("block", r"(^|[./-])porn[./-]", ("porn",)),
    ("block", r"(^|\.)ads\.", ("ads",)),
    ("block", r"/wp-login\.php", ("wp", "login")),
    ("block", r"/cgi-bin/", ("cgi", "bin")),
    ("block", r"^blog\.[^/]*/de/[0-9]+\.html\z", ("blog", "de", "html")),
    ("block", r"^m\.[^/]*/es/[0-9]+/\z", ("m", "es")),
    ("allow", r"^blog\.example\.org/", ("blog", "example", "org")),
]
MAX_RULES = 100_000
TOKEN = "[0-9a-z]+"


def rules_table(host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> list[tuple]:
    """(rule, action, pattern, level, length, tokens): host rules are level 1, the method's level 0."""
    out = []
    for action, host, path in host_rules:
        # a run at the end of the rule may go on in the URL: no whole token
        low = re.sub("[A-Z]", lambda m: m[0].lower(), host + path)
        tokens = [m[0] for m in re.finditer(TOKEN, low) if m.end() < len(low)]
        out.append((host + path, action, rf"^([^/]*\.)?{re.escape(host)}{re.escape(path)}", 1, len(host + path), tokens))
    for action, pattern, tokens in pattern_rules:
        out.append((pattern, action, pattern, 0, len(pattern), list(tokens)))
    if len(out) > MAX_RULES:
        raise ValueError(f"{len(out)} rules; the index is sent to every task and holds {MAX_RULES} at most")
    return out


def parsed(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, path)."""
    at = F.instr(F.col("url"), "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    lower = _lower(host)
    return pages.select(F.col("page_id"), F.col("url").cast("string").alias("url")).select("page_id", lower.alias("host"), path.alias("path"))


def _lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _tokens() -> Column:
    return F.array_distinct(F.regexp_extract_all(_lower(F.concat("host", "path")), F.lit(TOKEN), F.lit(0)))


def rule_index(spark: SparkSession, urls: DataFrame, rules: list[tuple]) -> DataFrame:
    """(token, rule, action, pattern, level, length): each rule under its rarest token over all URLs, or the empty one."""
    wanted = sorted({t for r in rules for t in r[5]})
    counted = (urls.select(F.explode(_tokens()).alias("token")).filter(F.col("token").isin(wanted))
               .groupBy("token").agg(F.count(F.lit(1)).alias("n")).collect())  # a row a rule token
    n = {r["token"]: r["n"] for r in counted}
    rows = [(min(r[5], key=lambda t: (n.get(t, 0), t), default=""), *r[:5]) for r in rules]
    return spark.createDataFrame(rows, "token string, rule string, action string, pattern string, level int, length int")


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES) -> DataFrame:
    """page_id, host, path, rule (the host rule that fits, else null), verdict, matched (the rule behind the verdict)."""
    urls = parsed(pages)
    rules = rules_table(host_rules, pattern_rules)
    index = rule_index(pages.sparkSession, urls, rules)
    tokens = _tokens() if all(r[5] for r in rules) else F.concat(_tokens(), F.array(F.lit("")))
    asked = urls.withColumn("row_id", F.monotonically_increasing_id()).select("*", F.explode_outer(tokens).alias("token"))
    # host rules read the path as it stands, the method's rules its lower-cased form
    subject = F.when(F.col("level") == 1, F.concat("host", "path")).otherwise(_lower(F.concat("host", "path")))
    hit = F.when(F.regexp_like(subject, F.col("pattern")), F.struct("level", "length", "rule", "action"))
    best = (asked.join(F.broadcast(index), "token", "left")  # at most MAX_RULES rows
            .groupBy("row_id").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"),
                                   F.first("path").alias("path"), F.max(hit).alias("hit")))
    return best.select("page_id", "host", "path", F.when(F.col("hit.level") == 1, F.col("hit.rule")).alias("rule"),
                       F.coalesce(F.col("hit.action"), F.lit("allow")).alias("verdict"), F.col("hit.rule").alias("matched"))
