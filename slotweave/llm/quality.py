"""Document quality by regularised quadratic discriminant analysis over transformed statistics of the text.

Class sums, sums of products and counts of labelled documents are added up by Spark; each class covariance is shrunk towards the
pooled one and that towards its diagonal. A score is the logistic of the difference of the two log densities, each from a
Mahalanobis distance and a log determinant out of a Cholesky factor that is computed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slotweave.llm.common import Rolling, byte_values, chunks, flat, words
from slotweave.llm.substring import IS_WORD
from slotweave.session import cut_lineage

_CODES = np.arange(256)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LETTER = _UPPER | ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_PLAIN = np.isin(_CODES, list(b".,;:'\"()-"))
_END = np.isin(_CODES, list(b".!?"))
NAMES = [
    "size", "word_length", "upper", "symbols", "digits", "commas_and_stops", "exclaims", "letterless_words", "mixed_words",
    "different_words", "repeated_neighbours", "repeated_threes", "words_a_sentence", "words_a_line",
]
WIDTH = len(NAMES)


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Square root of a share, damped for short texts: near zero it spreads like a normal variable."""
    return np.sqrt((part + 0.02) / (whole + 1.0))


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of transformed statistics per text; all are defined for empty texts too."""
    start, end, first = words(data, at, IS_WORD)
    n, docs = np.diff(first).astype(float), len(at) - 1
    doc_of = np.repeat(np.arange(docs), np.diff(first))

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[at]).astype(float)

    def in_words(flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[end] - sums[start]

    def words_with(flags: np.ndarray) -> np.ndarray:
        return np.bincount(doc_of[flags], minlength=docs).astype(float)

    letters, digits = _LETTER[data], _DIGIT[data]
    other = ~(letters | digits | _PLAIN[data] | ~IS_WORD[data])
    solid = per_doc(IS_WORD[data])
    letters_in, other_in = in_words(letters), in_words(other)
    hashes = Rolling(byte_values(data)).spans(start, end)
    same = np.zeros(len(start), bool)
    if len(start) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (doc_of[1:] == doc_of[:-1])
    threes = Rolling(hashes).windows(3)

    def different(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        return np.bincount(doc[new], minlength=docs).astype(float)

    inside = doc_of[: len(threes)] == doc_of[2:] if len(threes) else np.empty(0, bool)
    in_threes = np.maximum(n - 2, 0)
    columns = [
        np.log1p(n), np.log((solid + 5) / (n + 1)), _share(per_doc(_UPPER[data]), solid), _share(per_doc(other), solid), _share(per_doc(digits), solid),
        _share(per_doc(_PLAIN[data]), solid), _share(per_doc(data == 33), solid), _share(words_with(letters_in == 0), n), _share(words_with((other_in > 0) & (letters_in > 0)), n),
        np.log((different(hashes, doc_of) + 1) / (np.sqrt(n) + 1)), _share(words_with(same), n),
        _share(in_threes - different(threes[inside], doc_of[: len(threes)][inside]), in_threes),
        np.log((n + 1) / (per_doc(_END[data]) + 1)), np.log((n + 1) / (per_doc(data == 10) + 1)),
    ]
    return np.stack(columns, 1)


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``_x``, the statistics of ``text``."""

    def made(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            rows = [statistics(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in chunks(at)]
            x = np.concatenate(rows) if rows else np.empty((0, WIDTH))
            arrays = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * WIDTH), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [arrays], names=[*keep, "_x"])

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "_x array<double>"])
    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(made, schema)


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors and log determinants of classes 0 and 1, and the log prior ratio."""

    means: np.ndarray
    factors: np.ndarray
    log_dets: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        density = []
        for mean, factor, log_det in zip(self.means, self.factors, self.log_dets):
            z = (x - mean) @ factor.T
            density.append(-0.5 * ((z * z).sum(1) + log_det))
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0] + self.prior, -500, 500)))


def fit(labelled: DataFrame, shrink: float = 0.1, to_diagonal: float = 0.1) -> Discriminant:
    """From rows _x, label (0 or 1). Without rows of both classes every score is the share of label 1 (1 without any)."""

    def sums(batches):
        for batch in batches:
            x = batch.column("_x").values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if batch.num_rows else np.empty((0, WIDTH))
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for k in (0, 1):
                own = np.column_stack([np.ones((label == k).sum()), x[label == k]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full((WIDTH + 1) ** 2, k, np.int32)), pa.array(np.arange((WIDTH + 1) ** 2, dtype=np.int32)), pa.array((own.T @ own).ravel())],
                    names=["label", "cell", "value"],
                )

    parts = labelled.select(F.col("label").cast("int").alias("label"), "_x").mapInArrow(sums, "label int, cell int, value double")
    table = np.zeros((2, (WIDTH + 1) ** 2))
    for row in parts.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():  # 2 * (WIDTH + 1) ** 2 rows at most
        table[row["label"], row["cell"]] = row["value"]
    table = table.reshape(2, WIDTH + 1, WIDTH + 1)
    n = table[:, 0, 0]
    if min(n) < 1:
        prior = 0.0 if n.sum() == 0 else 500.0 * (1 if n[1] else -1)
        return Discriminant(np.zeros((2, WIDTH)), np.stack([np.eye(WIDTH)] * 2), np.zeros(2), prior or 500.0)
    means = table[:, 0, 1:] / n[:, None]
    scatter = table[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(0) / n.sum()
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(WIDTH)
    factors, log_dets = [], []
    for k in (0, 1):
        weight = shrink + (1 - shrink) * WIDTH / (WIDTH + n[k])  # a small class leans on the pooled one
        covariance = (1 - weight) * scatter[k] / n[k] + weight * pooled
        cholesky = np.linalg.cholesky(covariance)
        factors.append(np.linalg.inv(cholesky))
        log_dets.append(2 * np.log(np.diag(cholesky)).sum())
    return Discriminant(means, np.stack(factors), np.array(log_dets), float(np.log(n[1] / n[0])))


def is_held_out(folds: int = 5):
    """Rows no label is learnt from: crc32 of the id as text leaves no remainder; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def scored(feats: DataFrame, model: Discriminant, keep: list[str]) -> DataFrame:
    shipped = feats.sparkSession.sparkContext.broadcast(model)  # two matrices of WIDTH squared

    def made(batches):
        for batch in batches:
            x = batch.column("_x").values.to_numpy(zero_copy_only=False).reshape(-1, WIDTH) if batch.num_rows else np.empty((0, WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(shipped.value.score(x))], names=[*keep, "_score"])

    schema = ", ".join([*(f"`{c}` {feats.schema[c].dataType.simpleString()}" for c in keep), "_score double"])
    return feats.select(*keep, "_x").mapInArrow(made, schema)


def learn(docs: DataFrame, labels: DataFrame, shrink: float = 0.1, to_diagonal: float = 0.1) -> tuple[DataFrame, Discriminant]:
    """Statistics of all rows (doc_id, _x), and the discriminant from all labelled ones outside the held-out fifth."""
    feats = cut_lineage(features(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ["doc_id"]))
    marks = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    return feats, fit(feats.filter(~is_held_out()).join(marks, "doc_id"), shrink, to_diagonal)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, shrink: float = 0.1, to_diagonal: float = 0.1) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text), learning from ``labels`` (doc_id, quality) outside the held-out fifth.

    Returns doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (1 if score >= threshold, else 0).

    Null or empty text: scored by its statistics, which are defined. Null quality or doc_id: no label. Repeated rows: each is
    scored, and each pair with a label is learnt from. One class or no labels: scores are constant. Empty table: no rows. Only
    the named columns are read.
    """
    feats, model = learn(docs, labels, shrink, to_diagonal)
    out = scored(feats, model, ["doc_id"])
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("_score").alias("score"), F.when(F.col("_score") >= threshold, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more. Read twice, not shuffled; a row is judged where it stands."""
    _, model = learn(docs, labels)

    def kept(batches):
        for batch in batches:
            data, at = flat(batch.column("text"))
            good = [model.score(statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])) >= threshold for i, j in chunks(at)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return docs.mapInArrow(kept, docs.schema)
