"""URL filters by a sort-merge range join.

A host becomes a canonical key of its labels in reverse order, each ended by a dot (``www.example.org``
is ``org.example.www.``). A rule's host and its subdomains are then one interval of keys,
``[key, key with the last dot raised)``, and the intervals of all rules nest. Opening and closing events
of the intervals are merged with the URL keys in sorted order; the sweep carries the stack of active
hosts (each event holds the stack after it). A second sweep of the same kind runs for each host on a URL's
stack over the paths of its rules: a rule's path is the interval of all paths that start with it, the intervals
nest again, and each event holds the longest path that is active after it. So a URL meets one rule for each
of its stacked hosts, however many rules they have, and takes the longest.

Everything is DataFrame expressions. URLs are dealt to sweeps by a hash of url and id, so one hot host
is spread evenly; each sweep gets all events, whose number is the rules' (four times) times the sweeps. No
rule is dropped and nothing is broadcast or collected.

Null urls and urls without ``://`` have an empty host and an empty path and match no rule. Repeated
rows, and rows that share an id, are judged each by itself. Urls of any length are judged whole. Of rules with
one host and path ``block`` holds. A null path is an empty one; rules with a null host or action are left out.
Equally long rules of one url: the longer host first. Further columns, whatever their names, are not looked at.
An empty table gives an empty result; without rules the default holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty if there is none."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.when(at > 0, F.translate(host, _UPPER, _LOWER)).otherwise("")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.substr(url, at + 3)
    return F.when(at > 0, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")


def host_key(host: Column) -> Column:
    """Labels in reverse order, each with a dot after it."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _raised(key: Column) -> Column:
    """The least bytes after all that start with these: the last byte plus one (255 is in no UTF-8)."""
    n = F.octet_length(key)
    last = F.conv(F.hex(F.substr(key, n, F.lit(1))), 16, 10).cast("int")
    return F.concat(F.substr(key, F.lit(1), n - 1), F.unhex(F.lpad(F.hex(last + 1), 2, "0")))


def _host_events(rules: DataFrame) -> DataFrame:
    """(key, kind, stack): ends of the hosts' intervals, each with the hosts that are active after it."""
    nodes = rules.select("host", host_key(F.col("host")).alias("key")).distinct()
    labels = F.split(F.expr("substring(key, 1, length(key) - 1)"), r"\.")
    above = nodes.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, 1, i), "."), F.lit(".")))).alias("up"))
    stacks = (
        above.join(nodes.select(F.col("key").alias("up"), "host"), "up")
        .groupBy("key")
        .agg(F.collect_list("host").alias("stack"), F.collect_list(F.when(F.col("up") != F.col("key"), F.col("host"))).alias("below"))
    )  # a host for each label at most
    raised = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))  # "/" follows "."
    return stacks.select("key", F.lit(1).alias("kind"), "stack").unionByName(stacks.select(raised.alias("key"), F.lit(0).alias("kind"), F.col("below").alias("stack")))


def _path_events(rules: DataFrame) -> DataFrame:
    """(node, key, kind, top): ends of the paths' intervals of each host, each with the longest path active after it."""
    own = rules.select(F.col("host").alias("node"), "path", "action", F.encode("path", "utf-8").alias("key"))
    prefixes = F.transform(F.sequence(F.lit(0), F.char_length("path")), lambda i: F.substring("path", F.lit(1), i))
    above = own.select("node", "path", F.explode(prefixes).alias("up")).filter("up <> path")
    above = above.join(own.select("node", F.col("path").alias("up"), "action"), ["node", "up"])
    rank = F.struct(F.char_length("up").alias("n"), F.col("up").alias("path"), F.col("action").alias("action"))
    above = above.groupBy("node", "path").agg(F.max(rank).alias("below"))
    own = own.join(above, ["node", "path"], "left")
    top = F.struct(F.char_length("path").alias("n"), F.col("path").alias("path"), F.col("action").alias("action"))
    none = F.struct(F.lit(-1).alias("n"), F.lit(None).cast("string").alias("path"), F.lit(None).cast("string").alias("action"))
    closing = own.filter("path <> ''").select("node", _raised(F.col("key")).alias("key"), F.lit(0).alias("kind"), F.coalesce("below", none).alias("top"))
    return own.select("node", "key", F.lit(1).alias("kind"), top.alias("top")).unionByName(closing)


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id", default: str = "allow", sweeps: int | None = None) -> DataFrame:
    """(key, host, path, rule, verdict) of every url; ``rules`` has host, path and action (allow or block)."""
    spark = pages.sparkSession
    sweeps = sweeps or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = pages.select(F.col(f"`{key}`").alias("id"), F.col(f"`{url}`").cast("string").alias("u"))
    urls = own.select("id", url_host(F.col("u")).alias("host"), url_path(F.col("u")).alias("path"), F.pmod(F.xxhash64("id", "u"), F.lit(sweeps)).alias("sweep"))
    urls = urls.select("sweep", host_key(F.col("host")).alias("key"), F.lit(2).alias("kind"), F.struct("id", "host", "path").alias("row"))
    clean = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), F.lower("action").alias("action")).dropna(subset=["host", "action"])
    clean = clean.groupBy("host", "path").agg(F.max("action").alias("action"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long")))
    merged = urls.unionByName(_host_events(clean).withColumn("sweep", every), allowMissingColumns=True)
    order = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.withColumn("active", F.last("stack", ignorenulls=True).over(order)).filter("kind = 2")
    # One copy of a url for each host on its stack, and one without a host: the sweep of paths keeps them together.
    nodes = F.explode(F.concat(F.array(F.lit(None).cast("string")), F.coalesce("active", F.array().cast("array<string>"))))
    copies = swept.withColumn("uid", F.monotonically_increasing_id()).select("sweep", "row", "uid", nodes.alias("node"))
    copies = copies.select("sweep", "node", F.encode("row.path", "utf-8").alias("key"), F.lit(2).alias("kind"), "row", "uid")
    merged = copies.unionByName(_path_events(clean).withColumn("sweep", every), allowMissingColumns=True)
    order = Window.partitionBy("sweep", "node").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = merged.withColumn("open", F.last("top", ignorenulls=True).over(order)).filter("kind = 2")
    n = F.char_length("node") + F.col("open.n")
    best = F.when(F.col("open.path").isNotNull(), F.struct(n, F.char_length("node"), F.concat("node", "open.path").alias("rule"), F.col("open.action").alias("action")))
    judged = swept.groupBy("sweep", "uid").agg(F.first("row").alias("row"), F.max(best).alias("best"))
    return judged.select(
        F.col("row.id").alias(key),
        F.col("row.host").alias("host"),
        F.col("row.path").alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.action"), F.lit(default)).alias("verdict"),
    )
