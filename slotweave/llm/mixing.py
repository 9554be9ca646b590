"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document posterior probabilities of domains. Document rates r >= 0 are then fitted by
projected gradient least squares so that the expected domain token totals sum(r * tokens * posterior) meet the targets:

    minimise  sum_d (sum_i r_i w_i p_id - t_d)^2 / t_d + ridge * sum_i w_i (r_i - 1)^2,   w_i = tokens_i / all tokens

Steps are accelerated by momentum. A step needs the domain totals only, one small aggregate over all documents. The driver keeps the residuals of the
steps so far, a few numbers each; tasks replay them to get the current rates, so no state of the size of the corpus is written between steps.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import Rolling, byte_values, chunks, flat, free_prefix, words
from slotweave.llm.substring import IS_WORD
from slotweave.session import cut_lineage

BUCKETS = 1 << 16
#: How near totals come to their targets, as a share of each.
TOLERANCE = 0.005
_LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
_CORE = (_LOWER >= 97) & (_LOWER <= 122) | (_LOWER >= 128)


def _buckets(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and bucket of each different word (letters only, lower-cased) of each document."""
    low = _LOWER[data]
    start, end, first = words(low, at, _CORE)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(first))
    bucket = (Rolling(byte_values(low)).spans(start, end) >> np.uint64(48)).astype(np.int64)
    return np.divmod(np.unique(doc * BUCKETS + bucket), BUCKETS)


def fit_domains(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = 20_000, smooth: float = 5.0) -> np.ndarray:
    """Log weights of a naive Bayes classifier over hashed words: one row per domain; the last column holds the prior.

    ``labelled`` has doc_id and domain. At most ``sample`` labelled rows, chosen by hash, are learnt from; their ids are broadcast.
    """
    known = labelled.select(F.col("doc_id").cast("bigint").alias("doc_id"), "domain").filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").select("text", "domain")

    def counted(batches):
        table = np.zeros((len(domains), BUCKETS + 1))
        for batch in batches:
            data, at = flat(batch.column("text"))
            own = np.array([domains.index(x) for x in batch.column("domain").to_pylist()], np.int64)
            for i, j in chunks(at):
                doc, bucket = _buckets(data[at[i] : at[j]], at[i : j + 1] - at[i])
                np.add.at(table, (own[i:j][doc], bucket), 1)
            np.add.at(table, (own, BUCKETS), 1)
        k, cell = np.nonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(cell), pa.array(table[k, cell])], names=["k", "cell", "n"])

    sums = rows.mapInArrow(counted, "k bigint, cell bigint, n double").groupBy("k", "cell").agg(F.sum("n").alias("n"))
    table = np.zeros((len(domains), BUCKETS + 1))
    for r in sums.collect():  # at most domains * (BUCKETS + 1) numbers
        table[r["k"], r["cell"]] = r["n"]
    seen = table[:, -1:]
    usual = (table[:, :-1].sum(0) + 0.5) / (seen.sum() + 1)  # rare words say little about small domains
    weights = np.log((table[:, :-1] + smooth * usual) / (seen + smooth))
    return np.column_stack([weights, np.log((seen + 1) / (seen.sum() + len(domains)))])


def memberships(docs: DataFrame, weights: np.ndarray, keep: list[str], rates=None) -> DataFrame:
    """``keep``, n_tokens and posterior (array over domains) of every row; with ``rates``, a function of the posteriors, ``rate`` too."""
    shipped = docs.sparkSession.sparkContext.broadcast(weights)
    types = dict(docs.dtypes)

    def made(batches):
        for batch in batches:
            w = shipped.value
            data, at = flat(batch.column("text"))
            tokens, posterior = [np.empty(0, np.int64)], [np.empty((0, len(w)))]
            for i, j in chunks(at):
                piece, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
                doc, bucket = _buckets(piece, own)
                log = np.stack([np.bincount(doc, row[bucket], minlength=j - i) + row[-1] for row in w], 1) if len(doc) else np.tile(w[:, -1], (j - i, 1))
                p = np.exp(log - log.max(1, keepdims=True))
                posterior.append(p / p.sum(1, keepdims=True))
                tokens.append(np.diff(words(piece, own, IS_WORD)[2]))
            p = np.concatenate(posterior)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(p) + 1, dtype=np.int32) * len(w)), pa.array(p.ravel()))
            more = [] if rates is None else [pa.array(rates(p))]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(np.concatenate(tokens)), lists, *more], names=[*keep, "n_tokens", "posterior", "rate"][: len(keep) + 2 + len(more)])

    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), "n_tokens bigint, posterior array<double>" + (", rate double" if rates else "")])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(made, schema)


def replay(posterior: np.ndarray, pulls: np.ndarray, step: float, ridge: float, ahead: bool) -> np.ndarray:
    """Rates after the steps whose domain pulls are given, from one for all; ``ahead``: where the next pull is to be measured."""
    rate = look = np.ones(len(posterior))
    for k, pull in enumerate(pulls):
        before, rate = rate, np.maximum(0.0, look - step * (posterior @ pull + ridge * (look - 1)))
        look = rate + k / (k + 3) * (rate - before)
    return look if ahead else rate


def with_rates(members: DataFrame, pulls: np.ndarray, step: float, ridge: float, ahead: bool = False) -> DataFrame:
    """``members`` with the column ``rate``."""
    keep = members.columns

    def made(batches):
        for batch in batches:
            p = batch.column("posterior").values.to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) if batch.num_rows else np.empty((0, pulls.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(replay(p, pulls, step, ridge, ahead))], names=[*keep, "rate"])

    return members.mapInArrow(made, ", ".join([*(f"`{c}` {t}" for c, t in members.dtypes), "rate double"]))


@dataclass
class Fit:
    """Domain pulls of each step, the step size, the targets after limits, and by how much of itself a target is missed at most."""

    pulls: np.ndarray
    step: float
    targets: np.ndarray
    missed: float


def limited(targets: np.ndarray, share: np.ndarray, at_most: np.ndarray) -> np.ndarray:
    """Targets of which those marked are no more than the present shares; what they leave goes to the others in proportion."""
    low = np.where(at_most, np.minimum(targets, share), targets)
    rest = low[~at_most].sum()
    return np.where(at_most, low, low * (1 + (targets - low).sum() / rest)) if rest > 0 else targets


def fit_pulls(members: DataFrame, targets: np.ndarray, ridge: float = 1e-3, steps: int = 40, tolerance: float = TOLERANCE, at_most: np.ndarray | None = None) -> Fit:
    """Projected-gradient steps for all rows of ``members`` (n_tokens, posterior).

    ``targets``: shares of all tokens, as wanted, summing to any total; those that ``at_most`` marks are upper limits: such a domain is never
    raised. Ends when the totals are within ``tolerance`` of the targets, as a share of each, or after ``steps`` steps. A domain nobody belongs to
    cannot be met and is left out of the sum.
    """
    k = len(targets)
    mass = F.col("n_tokens").cast("double")
    cells = [F.sum(mass * F.col("posterior")[a] * F.col("posterior")[b]) for a in range(k) for b in range(k)]
    totals = members.agg(F.sum(mass), *[F.sum(mass * F.col("posterior")[a]) for a in range(k)], *cells).first()
    everything = totals[0] or 0.0
    pulls = np.empty((0, k))
    if not everything:
        return Fit(pulls, 0.0, targets, 0.0)
    share = np.array([totals[1 + a] for a in range(k)]) / everything
    gram = np.array(totals[1 + k :]).reshape(k, k) / everything
    reach = share > 1e-9
    if at_most is not None:
        targets = limited(targets, share, at_most)
    scale = np.where(reach, 1 / np.sqrt(np.where(targets > 0, targets, 1.0)), 0.0)
    step, now = 1 / (np.linalg.eigvalsh(scale[:, None] * gram * scale[None, :]).max() + ridge), share
    while True:
        residual = (now - targets) * scale
        missed = float((np.abs(residual) * scale).max())
        if missed <= tolerance or len(pulls) == steps:
            return Fit(pulls, step, targets, missed)
        pulls = np.vstack([pulls, residual * scale])
        sums = with_rates(members, pulls, step, ridge, ahead=True).agg(*[F.sum(mass * F.col("rate") * F.col("posterior")[a]) for a in range(k)]).first()
        now = np.array(sums) / everything


def soft_mixing(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], ridge: float = 1e-3, steps: int = 40, sample: int = 20_000, extra: tuple[str, ...] = (), seed: int = 7, at_most: tuple[str, ...] = ()) -> DataFrame:
    """Rates and copies that mix ``docs`` (doc_id, text) to ``targets`` (domain to share of all tokens).

    Domains in ``at_most`` are never raised above their present share. A warning says by how much a target is missed if ``steps`` steps don't meet all.

    Returns doc_id, the columns ``extra``, n_tokens, posterior (array in the order of the targets' sorted names), rate and copies: the rate rounded up
    or down by a hash of id and text, so that copies equal rates in expectation. Documents are read twice and never shuffled.

    Null or empty text: no tokens, the prior as posterior, a rate like any other. Null doc_id: never labelled. Repeated rows: each gets
    the same rate. Labels of other domains, or of ids that are not there, are ignored; no labels: all domains are alike. Empty table: no rows.
    Other columns are not read; of ``extra``, columns named like returned ones are left out.
    """
    domains = sorted(targets)
    extra = tuple(c for c in extra if c not in ("doc_id", "n_tokens", "posterior", "rate", "copies"))
    weights = fit_domains(docs, labelled, domains, sample)
    members = cut_lineage(memberships(docs.select("text"), weights, []))
    fit = fit_pulls(members, np.array([targets[d] for d in domains]), ridge, steps, at_most=np.array([d in at_most for d in domains]))
    if fit.missed > TOLERANCE:
        warnings.warn(f"after {steps} steps a target is missed by {fit.missed:.1%} of itself", stacklevel=2)
    pulls, step = fit.pulls, fit.step
    own_draw = free_prefix(docs.columns) + "draw"
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    every = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *extra, draw.alias(own_draw), *([] if "text" in extra else ["text"]))
    rated = memberships(every, weights, ["doc_id", *extra, own_draw], lambda p: replay(p, pulls, step, ridge, False))
    return rated.withColumn("copies", F.floor(F.col("rate") + F.col(own_draw)).cast("int")).drop(own_draw)
