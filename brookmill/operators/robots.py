"""Robots rules: bodies parsed into rule rows, and URLs decided by the longest match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brookmill.functions import url as U

MAX_RULES, MAX_RECORDS, MAX_LINE = 4096, 8192, 8192


def agent_token(value: Column) -> Column:
    """The product token: the first word up to a slash, lower-cased; * stays."""
    word = F.regexp_extract(F.trim(value), r"^(\S+)", 1)
    return F.when(word == "*", word).otherwise(F.lower(F.substring_index(word, "/", 1)))


def pattern_octets(value: Column) -> Column:
    """Escapes in upper case; repeated wildcards as one. ASCII patterns only."""
    upper = F.regexp_replace(value, r"\*+", "*")
    parts = F.split(upper, "%")
    fixed = F.transform(parts, lambda p, i: F.when((i > 0) & p.rlike("^[0-9A-Fa-f]{2}"), F.concat(F.upper(F.substring(p, 1, 2)), F.substring(p, 3, 100000))).otherwise(p))
    return F.array_join(fixed, "%")


def specificity(pattern: Column) -> Column:
    """Octets of the pattern; an escape counts as one, a wildcard as none."""
    return F.length(F.replace(F.regexp_replace(pattern, "%[0-9A-F]{2}", "x"), F.lit("*"), F.lit("")))


def as_regex(pattern: Column, anchored: Column) -> Column:
    quoted = F.regexp_replace(pattern, r"([\\.+?^$(){}\[\]|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(quoted, F.lit("*"), F.lit(".*")), F.when(anchored, "$").otherwise(""))


def parse(bodies: DataFrame) -> DataFrame:
    """Rules of each robots body (origin, body): origin, agent, allow, pattern, anchored, specificity, ord.

    Consecutive user-agent lines open one group; a user-agent line after rules opens the next; blank lines do not end
    a group; rules before any agent, without a value, or not rooted are dropped.
    """
    body = F.regexp_replace(F.col("body"), "^﻿", "")
    lines = bodies.select("origin", F.posexplode(F.split(body, r"\r\n|\r|\n")).alias("pos", "line")).where(F.length("line") <= MAX_LINE)
    clean = F.trim(F.substring_index("line", "#", 1))
    rec = lines.select("origin", "pos", clean.alias("line")).where(F.contains("line", F.lit(":")))
    rec = rec.select("origin", "pos", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.expr("substring(line, instr(line, ':') + 1)")).alias("value"))
    w = Window.partitionBy("origin").orderBy("pos")
    is_agent = F.col("field") == "user-agent"
    rooted = F.col("field").isin("allow", "disallow") & F.col("value").startswith("/")
    rec = rec.withColumn("kind", F.when(is_agent, "agent").when(rooted, "rule")).where("kind IS NOT NULL")
    rec = rec.withColumn("opens", F.when(is_agent & (F.coalesce(F.lag("kind").over(w), F.lit("rule")) == "rule"), 1).otherwise(0))
    rec = rec.withColumn("grp", F.sum("opens").over(w)).where("grp > 0")
    agents = rec.where("kind = 'agent'").select("origin", "grp", agent_token(F.col("value")).alias("agent")).where("agent <> ''").distinct()
    rules = rec.where("kind = 'rule'")
    anchored = F.col("value").endswith("$")
    rules = rules.select("origin", "grp", F.col("pos").alias("ord"), (F.col("field") == "allow").alias("allow"), pattern_octets(F.regexp_replace("value", r"\$$", "")).alias("pattern"), anchored.alias("anchored"))
    rules = rules.withColumn("specificity", specificity(F.col("pattern"))).where("specificity > 0")
    return agents.join(rules, ["origin", "grp"], "left").drop("grp")


def decide(urls: DataFrame, rules: DataFrame, product: str) -> DataFrame:
    """``urls`` (with url) plus allowed and specificity: of the groups that name the product, else of *, the longest
    matching rule, allow winning ties; no match allows; the robots file itself is always allowed."""
    named = rules.where(F.col("agent").isin(product.lower(), "*"))
    exact = F.max(F.when(F.col("agent") == product.lower(), 1).otherwise(0)).over(Window.partitionBy("origin"))
    own = named.withColumn("exact", exact).where((F.col("exact") == 0) | (F.col("agent") == product.lower())).where("pattern IS NOT NULL")
    own = own.select(F.col("origin").alias("o"), "allow", "specificity", as_regex(F.col("pattern"), F.col("anchored")).alias("rx")).distinct()
    u = urls.withColumns({"__o": U.origin(F.col("url")), "__p": F.coalesce(F.nullif(U.path(F.col("url")), F.lit("")), F.lit("/")), "__q": U.query(F.col("url"))})
    pq = F.when(F.col("__q") == "", F.col("__p")).otherwise(F.concat("__p", F.lit("?"), "__q"))
    per_origin = own.groupBy("o").agg(F.collect_list(F.struct("specificity", "allow", "rx")).alias("rules"))
    hit = F.array_max(F.transform(F.filter("rules", lambda r: F.regexp(F.col("__pq"), r["rx"])), lambda r: F.struct(r["specificity"], r["allow"])))
    j = u.withColumn("__pq", pattern_octets(pq)).join(per_origin, F.col("__o") == F.col("o"), "left").withColumn("__hit", hit)
    free = (F.col("__p") == "/robots.txt") & (F.col("__q") == "")
    return j.select(*urls.columns, F.when(free, True).otherwise(F.coalesce("__hit.allow", F.lit(True))).alias("allowed"), F.when(free, 0).otherwise(F.coalesce("__hit.specificity", F.lit(0))).alias("specificity"))


def outcome(status: Column) -> Column:
    """What a robots fetch means: parse, allow_all, or deny_all."""
    return F.when(status.between(200, 299), "parse").when(status.isin(408, 425, 429) | (status >= 500) | status.isNull(), "deny_all").when(status.between(400, 499), "allow_all").otherwise("deny_all")
