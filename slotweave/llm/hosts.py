"""Quality rules of documents and of whole hosts, with DataFrame functions only.

Each document is judged by its own statistics. Failures are added up by host, each host's failure rate is shrunk towards the
corpus by a beta prior whose strength is estimated from all hosts, and documents of hosts whose shrunk rate reaches a limit go as well.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slotweave.session import cut_lineage

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
#: A host with at least one in so many of all rows is hot; there are no more hot hosts than this.
HOT = 1000
#: The weakest and the strongest prior, as rows it counts for.
STRENGTH = (1e-3, 1e6)


def _behind(df: DataFrame, keep: list[str], **made: Column) -> DataFrame:
    """Add columns behind a generator: later expressions read their values and don't compute them again."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def _repeated(hashes: Column, width: int) -> Column:
    """Places covered by windows, given by hash and place, whose hash occurs twice or more."""
    both = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def twice(s: Column) -> Column:
        same = lambda x, k: F.coalesce(F.get(s, k)["h"] == x["h"], F.lit(False))
        kept = F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(kept, lambda x: x["i"]))

    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-width).alias("last"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last"))
    # a lambda's variable holds its value: the sorted array is made once, not once for each element
    return F.element_at(F.transform(F.array(both), lambda s: F.aggregate(twice(s), start, step, lambda a: a["n"])), 1)


def document_statistics(docs: DataFrame, host: str = "source", width: int = 8) -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of every row of ``docs``.

    Windows are compared by 64-bit hashes of ``width`` word hashes, within one text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    own = ["doc_id", "host"]
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(host).cast("string").alias("host"), text.alias("text"))
    made = _behind(
        slim, own,
        words=F.transform(F.array_remove(F.split("text", "[ \t\n\x0b\f\r]+"), ""), lambda w: F.xxhash64(w)),
        lines=F.filter(F.split("text", "\n"), lambda x: _without(x, SPACES) != ""),
        word_chars=F.length(_without(F.col("text"), SPACES)).cast("bigint"),
        n_symbols=(F.length("text") - F.length(_without(F.col("text"), SYMBOLS))).cast("bigint"),
    )
    windows = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]))
    own += ["word_chars", "n_symbols"]
    made = _behind(
        made, own,
        n_words=F.size("words").cast("bigint"),
        n_dup_lines=(F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint"),
        windows=F.when(F.size("words") >= width, windows).otherwise(F.array().cast("array<bigint>")),
    )
    repeats = F.when(F.size("windows") == F.size(F.array_distinct("windows")), F.lit(0).cast("bigint")).otherwise(_repeated(F.col("windows"), width))
    return made.select("doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", repeats.alias("n_repeat_words"))


@dataclass
class Prior:
    """Beta prior of hosts' failure rates: its mean, and the rows it counts for."""

    mean: float
    strength: float


def prior(hosts: DataFrame) -> Prior:
    """Of rows host, n, failed, by moments: what hosts' rates differ by more than chance gives the strength.

    Without any row the mean is 0. Without two hosts, or if rates differ no more than by chance, the prior is as strong as can be.
    """
    n, f = F.col("n").cast("double"), F.col("failed").cast("double")
    k, rows, failed, squares, spread = hosts.agg(F.count("*"), F.sum(n), F.sum(f), F.sum(n * n), F.sum(f * f / n)).first()
    if not rows:
        return Prior(0.0, STRENGTH[1])
    mean = failed / rows
    chance, room = mean * (1 - mean), rows - squares / rows - (k - 1)
    if chance <= 0 or room <= 0:
        return Prior(mean, STRENGTH[1])
    within = ((spread - mean * failed) / chance - (k - 1)) / room  # correlation of two rows of one host
    return Prior(mean, min(max(1 / within - 1, STRENGTH[0]), STRENGTH[1]) if within > 0 else STRENGTH[1])


def host_verdicts(hosts: DataFrame, limit: float) -> DataFrame:
    """Rows host, n, failed with ``rate``, the posterior mean of the host's failure rate, and ``rejected``: whether it is ``limit`` or more."""
    p = prior(hosts)
    rate = (F.col("failed") + p.mean * p.strength) / (F.col("n") + p.strength)
    return hosts.withColumn("rate", rate).withColumn("rejected", F.col("rate") >= limit)


def host_quality(docs: DataFrame, host: str = "source", least_words: int = 20, repeat_percent: int = 30, limit: float = 0.5) -> DataFrame:
    """Judge every row of ``docs`` (doc_id, text, and ``host``, a column's name) by itself and by its host.

    Returns doc_id, host, the statistics, base_failed (under ``least_words`` words, or over ``repeat_percent`` percent of them in repeated
    windows), host_rate (the host's shrunk failure rate) and kept: false if base_failed or if the host's rate is ``limit`` or more.

    Null or empty text: no words, so it fails. A null host is no host: its rows count for none, host_rate is null and base_failed alone
    decides. Null or repeated doc_id: each row is judged and counted. Empty table: no rows. Other columns are not read.

    Rows of hot hosts meet the verdict in the task where they are; the others are shuffled by host, of which none has more than
    one in ``HOT`` rows.
    """
    return _judged(document_statistics(docs, host), least_words, repeat_percent, limit)


def _judged(stats: DataFrame, least_words: int, repeat_percent: int, limit: float) -> DataFrame:
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    stats = cut_lineage(stats.withColumn("base_failed", failed))
    hosts = cut_lineage(stats.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("bigint")).alias("failed")))
    rows = hosts.agg(F.sum("n")).first()[0] or 0
    verdicts = host_verdicts(hosts, limit).select("host", "n", F.col("rate").alias("host_rate"), "rejected")
    hot = F.broadcast(verdicts.filter(F.col("n") * HOT >= rows).drop("n"))  # HOT rows at most
    near = stats.join(hot, "host", "left").filter("rejected is not null or host is null")
    far = stats.filter("host is not null").join(hot, "host", "left_anti").join(verdicts.filter(F.col("n") * HOT < rows).drop("n"), "host", "left")
    both = near.unionByName(far)
    return both.select(*stats.columns, "host_rate", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"))
