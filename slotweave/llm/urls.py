"""URL filter: expressions of each URL, joined to rules by short hashes.

A URL is expanded into its host's suffixes times its path's prefixes. Expressions and rules meet on the first bytes of a SHA-256; the full digest
decides. Of the rules that fit, the longest wins. Only DataFrame functions are used, in tasks and on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Hex digits of the digest that are joined on.
SHORT = 8
#: Rules up to this number are sent to the tasks, where an expression of very many URLs needs no shuffle; beyond it, hits are joined by a shuffle.
FEW = 50_000


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, lower-cased in A-Z; path: then up to ``?``, ``#`` or the end."""
    begin = F.instr(url, "://")
    rest = F.when(begin > 0, F.substring(url, begin + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"\A([^?#]*)", 1)
    empty = F.lit("")
    return F.coalesce(_ascii_lower(host), empty), F.coalesce(path, empty)


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def prepared_rules(rules: DataFrame) -> DataFrame:
    """One row per (host, path): digest, its short form, the rule's text, verdict and precedence; block wins over allow for one rule.

    Rows with a null host, path or verdict are no rules.
    """
    host, path = _ascii_lower(F.col("host")), F.col("path")
    known = rules.filter("host is not null and path is not null and verdict is not null").select(host.alias("host"), path.alias("path"), "verdict")
    merged = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    return merged.select(
        _digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"), "verdict",
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), F.length("path").alias("path_size"),
    ).withColumn("short", F.substring("digest", 1, SHORT))


def url_verdicts(pages: DataFrame, rules: DataFrame, otherwise: str = "allow") -> DataFrame:
    """Judge every row of ``pages`` (page_id, url) by ``rules`` (host, path, verdict: allow or block).

    Returns page_id, host, path, rule (host and path of the rule that decided, else null) and verdict. A rule fits its host and all
    subdomains if the URL's path starts with the rule's; the longest rule wins, of equally long ones that with the longer host. URLs
    that no rule fits get ``otherwise``.

    A path is cut at the lengths that rules' paths have, so that prefixes of any form are exact; a host at its dots. Pages that share host and path are
    judged once; expressions that many URLs share are joined once.

    Null url, or one without ``://``: host and path empty. Null or repeated page_id: each row is judged. Empty tables: no rows, or
    ``otherwise`` for all. Other columns are not read.
    """
    known = prepared_rules(rules)
    sizes = sorted(r[0] for r in known.select("path_size").distinct().collect())  # lengths of rules' paths: small numbers, however many rules
    lengths = F.array(*map(F.lit, sizes)).cast("array<int>")
    host, path = host_and_path(F.col("url"))
    judged = pages.select("page_id", host.alias("host"), path.alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(lengths, lambda n: n <= F.length("path"))
    parts = judged.select("host", "path").distinct().select("host", "path", F.explode(suffixes).alias("suffix"), fitting.alias("cuts"))
    parts = parts.select("host", "path", "suffix", F.explode("cuts").alias("cut"))
    expressions = parts.select("host", "path", F.col("suffix"), F.substring(F.col("path"), F.lit(1), F.col("cut")).alias("prefix"))
    every = expressions.select("suffix", "prefix").distinct()
    every = every.withColumn("full", _digest(F.col("suffix"), F.col("prefix"))).withColumn("short", F.substring("full", 1, SHORT))
    hits = every.join(known, "short").filter("full = digest").select("suffix", "prefix", F.struct("size", "host_size", "rule", "verdict").alias("hit"))
    if known.count() <= FEW:  # hits are no more than rules
        hits = F.broadcast(hits)
    best = expressions.join(hits, ["suffix", "prefix"]).groupBy(F.struct("host", "path").alias("k")).agg(F.max("hit").alias("hit"))
    decided = best.select("k.host", "k.path", "hit.rule", "hit.verdict")
    return judged.join(decided, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
