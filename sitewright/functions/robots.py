"""robots.txt: groups, rules, policies and X-Robots-Tag directives.

The rule table is made with built-in functions (a new group begins where a user-agent line follows a rule); policies
and path tests are aggregations over it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import col

# Fixed value: how a part of an X-Robots-Tag line names the crawler that it is for.
SCOPED = r"(?i)^\s*([\w-]+(?:bot|user))\s*:\s*(.*)$"


def rules_table(robots: DataFrame, key: str = "site", raw: str = "raw") -> DataFrame:
    """key, grp, agent (lower case), path, allow of each rule; a group without rules has one row with null path."""
    line = F.regexp_replace(F.regexp_replace(F.col("line"), r"#.*", ""), r"(?U)^\s+|\s+\z", "")
    lines = robots.select(key, F.posexplode(F.split(F.regexp_replace(raw, "\r", ""), "\n")).alias("pos", "line")).select(key, "pos", line.alias("line"))
    lines = lines.select(key, "pos", F.lower(F.regexp_extract("line", r"^([A-Za-z-]+):", 1)).alias("name"), F.regexp_replace("line", r"^[^:]*:\s*", "").alias("value"))
    lines = lines.where(F.col("name").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(key).orderBy("pos")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("grp", F.sum(begins.cast("int")).over(order))
    agents = lines.where("name = 'user-agent'").select(key, "grp", F.lower("value").alias("agent")).distinct()
    rules = lines.where("name <> 'user-agent' and grp > 0").select(key, "grp", "pos", F.col("value").alias("path"), (F.col("name") == "allow").alias("allow"))
    return agents.join(rules, [key, "grp"], "left").select(key, "grp", "agent", "path", "allow", "pos")


def path_pattern(c) -> Column:
    """A rule's path as an anchored regular expression: * is any run, a final $ the end."""
    body = F.regexp_replace(col(c), r"\$\z", "")
    escaped = F.regexp_replace(F.regexp_replace(body, r"([\\.\[\](){}+?^|$])", r"\\$1"), r"\*+", ".*")
    return F.concat(F.lit("^"), escaped, F.when(col(c).endswith("$"), "\\z").otherwise(""))


def literal_length(c) -> Column:
    """What a rule's rank is: its length without wildcards and without the end mark."""
    return F.char_length(F.replace(F.regexp_replace(col(c), r"\$\z", ""), F.lit("*"), F.lit("")))


def _rules_for(rules: DataFrame, agents: DataFrame, key: str) -> DataFrame:
    """Rules of the groups that name the agent, or of the * groups if none does; if there is neither, all rules with both marks false."""
    named = agents.join(rules, [key], "left").withColumn("exact", F.lower("ua") == F.col("agent")).withColumn("star", F.col("agent") == "*")
    own = named.groupBy(key, "ua").agg(F.coalesce(F.bool_or("exact"), F.lit(False)).alias("explicit"), F.coalesce(F.bool_or("star"), F.lit(False)).alias("any_star"))
    return named.join(own, [key, "ua"]).where(F.when(F.col("explicit"), F.col("exact")).otherwise(F.coalesce("star", F.lit(False))) | (~F.col("explicit") & ~F.col("any_star")))


def policies(rules: DataFrame, agents: DataFrame, key: str = "site") -> DataFrame:
    """key, ua, policy: explicit- or star- with allow, block or partial, or none.

    The front page decides: if it is barred, the policy is block, or partial where some path is allowed; if it is open,
    the policy is allow, or partial where any rule names another path."""
    used = _rules_for(rules, agents, key)
    real = F.coalesce(F.col("path"), F.lit("")) != ""
    root = F.max(F.when(real & F.rlike(F.lit("/"), path_pattern("path")), F.struct(literal_length("path").alias("len"), "allow")))["allow"]
    has = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    agg = used.groupBy(key, "ua").agg(
        F.bool_or("explicit").alias("explicit"), F.bool_or("any_star").alias("any_star"), F.coalesce(root, F.lit(True)).alias("open"),
        has(real & F.col("allow")).alias("some_allowed"), has(real & (F.col("path") != "/")).alias("other_path"))
    effect = F.when(~F.col("open"), F.when(F.col("some_allowed"), "partial").otherwise("block")).when(F.col("other_path"), "partial").otherwise("allow")
    return agg.select(key, "ua", F.when(F.col("explicit"), F.concat(F.lit("explicit-"), effect)).when(F.col("any_star"), F.concat(F.lit("star-"), effect)).otherwise("none").alias("policy"))


def literal_prefix(c) -> Column:
    """What every path that a rule matches begins with: the rule up to its first wildcard or its end mark."""
    return F.substring_index(F.regexp_replace(col(c), r"\$\z", ""), "*", 1)


def allowed(rules: DataFrame, asked: DataFrame, key: str = "site") -> DataFrame:
    """asked (key, ua, target), each once, with `allowed`: the longest matching rule wins, a tie allows, no match allows.

    Rules are found by their literal prefix: of a target only the prefixes are looked up whose lengths occur among its crawler's
    rules.  A pattern is tried only where the rule goes on after the prefix."""
    used = _rules_for(rules, asked.select(key, "ua").distinct(), key).where("(explicit or any_star) and path <> ''")  # rules of other crawlers' groups alone bind nobody else
    used = used.groupBy(key, "ua", "path").agg(F.bool_or("allow").alias("allow"))
    used = used.withColumns({"prefix": literal_prefix("path"), "rank": literal_length("path"), "pattern": F.when(F.col("path") != literal_prefix("path"), path_pattern("path"))})
    lengths = used.groupBy(key, "ua").agg(F.collect_set(F.char_length("prefix")).alias("lengths"))  # no more than a path is long
    asked = asked.select(key, "ua", "target").distinct().join(lengths, [key, "ua"], "left")
    tried = asked.select(key, "ua", "target", F.explode_outer(F.filter("lengths", lambda n: n <= F.char_length("target"))).alias("n"))
    tried = tried.select(key, "ua", "target", F.substring("target", F.lit(1), F.col("n")).alias("prefix"))
    hit = tried.join(used, [key, "ua", "prefix"], "left").withColumn("hit", F.col("rank").isNotNull() & F.coalesce(F.expr("target rlike pattern"), F.lit(True)))
    won = F.max(F.when(F.col("hit"), F.struct("rank", "allow")))
    return hit.groupBy(key, "ua", "target").agg(F.coalesce(won["allow"], F.lit(True)).alias("allowed"))


def declared_sitemaps(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(r"(?im)^[ \t]*sitemap:[ \t]*(\S+)"), F.lit(1))


def directives(meta_robots, meta_googlebot, header, ua: str = "googlebot") -> Column:
    """Directive tokens that hold for a crawler, lower case.

    A header line is read segment by segment; `name: value` with a crawler's name (…bot, …user) switches the scope until
    the line ends, and a segment counts if its scope is everyone or the crawler.  none stands for noindex, nofollow."""
    words = lambda c: F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\s*:\s*", ":"), r"(?U)[,;\s]+")

    def walk(acc: Column, segment: Column) -> Column:
        switch = segment.rlike(SCOPED)
        scope = F.when(switch, F.lower(F.regexp_extract(segment, SCOPED, 1))).otherwise(acc["scope"])
        value = F.when(switch, F.regexp_extract(segment, SCOPED, 2)).otherwise(segment)
        keep = (scope == "") | (F.lit(ua.lower()) == scope)
        return F.struct(scope.alias("scope"), F.when(keep, F.concat(acc["out"], words(value))).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit("").alias("scope"), F.expr("cast(array() as array<string>)").alias("out"))
    header_tokens = F.flatten(F.transform(F.split(F.coalesce(col(header), F.lit("")), "\n"), lambda line: F.aggregate(F.split(line, ","), zero, walk, lambda acc: acc["out"])))
    own = words(meta_googlebot) if ua.lower().startswith("googlebot") else F.expr("cast(array() as array<string>)")
    every = F.filter(F.concat(words(meta_robots), own, header_tokens), lambda x: x != "")
    return F.when(F.array_contains(every, "none"), F.concat(every, F.array(F.lit("noindex"), F.lit("nofollow")))).otherwise(every)
