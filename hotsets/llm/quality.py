"""Quality scores by a regularised quadratic discriminant over document statistics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, keep_columns, map_batches, quoted

STATISTICS = ["words", "word_length", "upper", "digits", "symbols", "stops", "distinct", "top_word",
              "echo", "line_repeat", "line_length", "entropy", "symbol_end"]
#: pseudo-counts that pull the statistics of short texts towards ordinary values
_PRIOR = 20.0
_CLASS = np.zeros(256, np.int8)  # 0 other (letters beyond ASCII included), 1 upper, 2 digit, 3 stop, 4 symbol, 5 white
_CLASS[65:91], _CLASS[48:58] = 1, 2
for _c in range(33, 127):
    if not chr(_c).isalnum():
        _CLASS[_c] = 3 if chr(_c) in ".,;:?'\"-()" else 4
_CLASS[[9, 10, 11, 12, 13, 32]] = 5
_CLASS_TABLE = _CLASS.astype(np.uint8).tobytes()


def _logit(hits: float, of: float, usual: float) -> float:
    p = (hits + _PRIOR * usual) / (of + _PRIOR)
    return float(np.log(p / (1 - p)))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one text, in the order of ``STATISTICS``.

    Shares become smoothed log-odds and counts logarithms, which brings them near to normal.
    A NULL or empty text has the values of no evidence.
    """
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    of_byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    by = np.bincount(_CLASS, weights=of_byte, minlength=6)
    solid = float(len(raw) - by[5])
    counts = Counter(words)
    echo = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = of_byte[of_byte > 0] / max(len(raw), 1)
    kind = np.frombuffer(raw.translate(_CLASS_TABLE) + b"\x05", np.uint8)
    last = int(((kind[:-1] == 4) & (kind[1:] == 5)).sum())
    return [
        float(np.log1p(n)), float(np.log((solid + 5 * _PRIOR) / (n + _PRIOR))),
        _logit(by[1], solid, 0.03), _logit(by[2], solid, 0.005), _logit(by[4], solid, 0.005), _logit(by[3], solid, 0.03),
        float(np.log((len(counts) + _PRIOR) / (n + _PRIOR))), _logit(max(counts.values(), default=0), n, 0.05), _logit(echo, max(n - 1, 0), 0.01),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02), float(np.log((n + _PRIOR) / (len(lines) + 1))),
        float(-(share * np.log(share)).sum() * len(raw) + 3.0 * 10 * _PRIOR) / (len(raw) + 10 * _PRIOR), _logit(last, n, 0.01),
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``x`` (array of the statistics) of every row."""
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [statistics(t.as_py()) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return map_batches(src, run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class Discriminant:
    """Class means with the inverse Cholesky factors of the shrunken covariances."""

    counts: np.ndarray
    means: np.ndarray | None = None
    inverses: np.ndarray | None = None
    log_scale: np.ndarray | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, from the difference of the two Mahalanobis log densities."""
        n0, n1 = self.counts
        if self.means is None:  # one class has not been seen: nothing to tell apart
            return np.full(len(x), (n1 + 1) / (n0 + n1 + 1))
        logs = [np.log(self.counts[c]) - self.log_scale[c] - 0.5 * (((x - self.means[c]) @ self.inverses[c].T) ** 2).sum(axis=1) for c in (0, 1)]
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def held_out(doc_id):
    """The quarter of the documents that no label is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", shrink: float = 0.1, ridge: float = 1e-3) -> Discriminant:
    """Fit on all rows of ``stats`` that ``labels`` (doc_id, label 0 or 1) marks.

    Sums and cross products per class are added up by the executors; only these few numbers
    reach the driver.  Each class covariance is drawn towards the diagonal of the pooled one
    by ``shrink`` (more for classes of few rows) and gets ``ridge`` on its diagonal, then is
    factored once.  Rows with a NULL label, or with contradicting labels, are left out; repeated
    labels count once.
    """
    marks = (labels.where(F.col(label_col).isin(0, 1)).groupBy("doc_id").agg(F.min(label_col).cast("int").alias("y"), F.max(label_col).cast("int").alias("__y"))
             .where("y = __y").select("doc_id", "y"))
    rows = stats.join(marks, "doc_id").select("y", "x")
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 + d + d * d))
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, d)
            y = b.column("y").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                z = x[y == c]
                sums[c] += np.concatenate(([len(z)], z.sum(axis=0), (z.T @ z).ravel()))
        flat = sums.ravel()
        yield pa.record_batch([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], ["at", "s"])

    total = np.zeros(2 * (1 + d + d * d))
    for r in map_batches(rows, run, "at int, s double").groupBy("at").agg(F.sum("s").alias("s")).collect():
        total[r["at"]] = r["s"]
    total = total.reshape(2, -1)
    n = total[:, 0]
    if n.min() < 1:
        return Discriminant(n)
    means = total[:, 1:1 + d] / n[:, None]
    scatter = [total[c, 1 + d:].reshape(d, d) / n[c] - np.outer(means[c], means[c]) for c in (0, 1)]
    pooled = np.diag(np.diag((n[0] * scatter[0] + n[1] * scatter[1]) / n.sum()))
    inverses, log_scale = [], []
    for c in (0, 1):
        a = max(shrink, d / (d + n[c]))
        chol = np.linalg.cholesky((1 - a) * scatter[c] + a * pooled + ridge * np.eye(d))
        inverses.append(np.linalg.inv(chol))
        log_scale.append(np.log(np.diag(chol)).sum())
    return Discriminant(n, means, np.array(inverses), np.array(log_scale))


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """``doc_id``, ``score`` of every row of ``stats``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b.column("x").to_pylist(), float).reshape(-1, len(STATISTICS))
            yield pa.record_batch([b.column("doc_id"), pa.array(model.scores(x))], ["doc_id", "score"])

    return map_batches(stats, run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """``doc_id``, ``score`` of every row: how likely label 1 is, from the text alone.

    Labels are learned only outside the held-out quarter of ids.  NULL and empty texts get the
    score of a text without evidence; repeated rows get equal scores; without rows of both
    labels every row gets the same score, (ones + 1) / (rows + 1).
    """
    stats = handoff(document_statistics(docs, id_col, text_col))
    model = fit(stats.where(~held_out(F.col("doc_id"))).dropDuplicates(["doc_id", "x"]), labels, label_col)
    return score(stats, model)


def drop_low_quality(docs: DataFrame, labels: DataFrame, at_least: float = 0.7) -> DataFrame:
    """``docs`` without the rows that score below ``at_least``; the columns stay as they are.

    A document is rejected by its id, so rows of one id with different texts go if all go.
    """
    kept = quality_scores(docs, labels).where(F.col("score") >= at_least).select(F.col("doc_id").alias("__kept_id")).distinct()
    both = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept_id")), "left_semi")
    return keep_columns(both, docs.columns)
