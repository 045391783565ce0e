"""URL filters by a sort-merge range join, in DataFrame functions only.

A host's labels in reverse, each followed by a dot, are its key: hosts below a rule's host are exactly those whose keys
begin with the rule's key, and prefixes are intervals of the sorted order. Intervals of prefixes lie inside one another
or apart, so rules have levels, found as a running sum of +1 at starts and -1 at ends. One sorted sweep over starts,
ends and urls keeps, for each level, the rule that started last; those that still hold the url's place are the active
rules, the stack. A first sweep finds the rule hosts that a url lies below, a second one, over the paths of the rules of
each such host, the longest fitting path. Sweeps run range by range (``operators.ordered``): rules never meet in one task, and neither do
the urls of a frequent host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ragbench.llm.common import Columns, stored
from ragbench.operators.ordered import in_ranges, last_values, running_sums

#: (host, path, verdict) of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
#: The verdict on urls that no rule fits.
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Beyond every hexadecimal digit: a key with it is where the interval of the key's prefix ends.
AFTER = "G"


def host_of(url: Column) -> Column:
    """From behind the first :// up to /, ?, # or the end, A-Z in lower case; empty for null and where :// is missing."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """From behind the host up to ?, # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The labels in reverse, each with a dot behind it, as hexadecimal bytes."""
    return F.hex(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")).cast("binary"))


def path_key(host: Column, path: Column) -> Column:
    """A place in the paths below one host key."""
    return F.concat(host, F.lit("00"), F.hex(path.cast("binary")))


def stacks(points: DataFrame, point_order: list[str], rules: DataFrame, name: str) -> DataFrame:
    """The points (key, ...) with ``stack``, the keys of the rules (key) whose intervals hold them, outermost first.

    ``points`` have no two rows that are equal in the columns ``point_order``, by which rows of one key are dealt out.
    """
    starts = rules.select("key", F.lit(1).alias("step"))
    marks = in_ranges(starts.unionByName(rules.select(F.concat("key", F.lit(AFTER)).alias("key"), F.lit(-1).alias("step"))), ["key"], f"{name}-marks")
    levels = stored(running_sums(marks, ["key"], {"level": F.col("step")}).where("step = 1").select("key", "level"), f"{name}-levels")
    deepest = levels.agg(F.max("level")).first()[0] or 0
    if not deepest:
        return points.withColumn("stack", F.array().cast("array<string>"))
    events = levels.select("key", "level").unionByName(points.withColumn("level", F.lit(None).cast("long")), allowMissingColumns=True)
    # At equal keys rules come before points, as null is the least in the other columns.
    order = ["key", *point_order]
    swept = last_values(in_ranges(events, order, f"{name}-events"), order, {f"at{k}": F.when(F.col("level") == k, F.col("key")) for k in range(1, deepest + 1)})
    held = F.filter(F.array(*(F.col(f"at{k}") for k in range(1, deepest + 1))), lambda r: F.col("key").startswith(r))
    return swept.where("level is null").select(*points.columns, held.alias("stack"))


def rule_table(spark: SparkSession, rules) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """All rows and columns with ``host``, ``path``, ``rule`` (host and path of the rule, or null) and ``verdict``.

    ``rules`` has host, path and verdict. A rule fits its host and all hosts below it, if the url's path begins with the
    rule's; of those that fit, the longest (host and path together, then the host) wins. Rules with a null in host or
    verdict are passed over, a null path is empty, and of equal rules that with the least verdict counts (allow before
    block). Hosts of rules are taken in lower case (A-Z). A null url, or one without ://, has an empty host and path,
    which only a rule with an empty host fits. Repeated rows stay; columns named like outputs are replaced, all others stay,
    whatever their names; an empty table gives an empty table, and without rules every url gets the default.
    """
    table = Columns(pages)
    rows = table.rows.withColumns({"host": host_of(F.col(table.name(url))), "path": path_of(F.col(table.name(url)))})
    named = rules.where("host is not null AND verdict is not null").select(F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    named = stored(named.groupBy("host", "path").agg(F.min("verdict").alias("verdict")).withColumn("h", host_key(F.col("host"))).withColumn("key", path_key(F.col("h"), F.col("path"))), "url-rules")
    urls = stored(rows.groupBy("host", "path").count().select("host", "path", host_key(F.col("host")).alias("key")), "urls")
    below = stored(stacks(urls, ["path"], named.select(F.col("h").alias("key")).distinct(), "hosts").where(F.size("stack") > 0), "below")
    points = below.select("host", "path", F.explode("stack").alias("h")).select("host", "path", path_key(F.col("h"), F.col("path")).alias("key"))
    fitting = stacks(points, ["host"], named.select("key"), "paths").where(F.size("stack") > 0).select("host", "path", F.try_element_at("stack", F.lit(-1)).alias("best"))
    found = stored(fitting, "fitting")
    of = named.select(F.col("key").alias("best"), F.concat("host", "path").alias("rule"), "verdict", F.struct((F.length("host") + F.length("path")).alias("all"), F.length("host").alias("host")).alias("length"))
    judged = found.join(of.hint("shuffle_merge"), "best").groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), "length").alias("won"))
    judged = stored(judged.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "won.rule", "won.verdict"), "judged")
    out = rows.join(judged.hint("shuffle_merge"), (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left")
    return table.done(out, {"host": "host", "path": "path", "rule": "rule", "verdict": F.coalesce("verdict", F.lit(default))})


def op13_url_filter(pages: DataFrame) -> DataFrame:
    """Contract of the query: the four rules over every page; a url that none fits is allowed."""
    return judge_urls(pages.select("page_id", "url"), rule_table(pages.sparkSession, RULES)).select("page_id", "host", "path", "rule", "verdict")


def oracle() -> str:
    """DuckDB SQL for the query: all rules tried on each url, the longest first."""
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    ordered = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0])))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered)
    return f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} ELSE '{DEFAULT}' END AS verdict FROM u"""
