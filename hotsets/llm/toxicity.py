"""Toxicity categories predicted by a chain of linear classifiers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hotsets.llm.common import handoff, map_batches, quoted
from hotsets.llm.decontam import words_of

#: order of the chain; the label itself comes last and sees what the others made of the text
CHAIN = ["varied", "dense", "toxic"]
TRAIN_ROWS = 20_000
MARKERS = 128
PREFIXES = (5, 7)
#: longer runs of letters are read by grams of so many characters
LONG_WORD, GRAM = 64, 4
_FOLDS = 3


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    z = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(z.shape[1])
    penalty = np.full(z.shape[1], ridge)
    penalty[-1] = 1e-6
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    for _ in range(rounds):
        p = _sigmoid(z @ w)
        curve = z.T @ (z * (p * (1 - p) + 1e-9)[:, None]) + np.diag(penalty)
        move = np.linalg.solve(curve, z.T @ (y - p) - penalty * w)
        w += np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


@dataclass
class Chain:
    """Linear models in chain order; model k also reads the probabilities of the k categories before."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.centre) / self.scale
        for w in self.weights:
            z = np.column_stack([z, _sigmoid(z @ w[:-1] + w[-1])])
        return z[:, len(self.centre):]


def fit_chain(x: np.ndarray, y: np.ndarray, fold: np.ndarray) -> Chain:
    """Fit one model per column of ``y``.

    What a later model reads of an earlier one in training are out-of-fold predictions: each
    row's come from a model that has not seen its fold, as they will for new documents.
    """
    chain = Chain(x.mean(axis=0), x.std(axis=0) + 1e-6)
    z = (x - chain.centre) / chain.scale
    for k in range(y.shape[1]):
        chain.weights.append(fit_linear(z, y[:, k]))
        held = np.zeros(len(z))
        for f in np.unique(fold):
            w = fit_linear(z[fold != f], y[fold != f, k]) if (fold != f).any() else chain.weights[-1]
            held[fold == f] = _sigmoid(z[fold == f] @ w[:-1] + w[-1])
        z = np.column_stack([z, held])
    return chain


def tokens_of(word: bytes) -> list[bytes]:
    """A word and its beginnings of 5 and 7 bytes, each marked as such: stems of one family.  A run of more than
    ``LONG_WORD`` bytes is no word (scripts without blanks): its distinct character grams stand for it."""
    if len(word) > LONG_WORD:
        text = word.decode("utf-8", "replace")
        return [b"~" + text[i:i + GRAM].encode() for i in {text[i:i + GRAM]: i for i in range(len(text) - GRAM + 1)}.values()]
    return [word, *(b"^" + word[:k] for k in PREFIXES if len(word) > k)]


def _features(words: list[bytes], at: dict[bytes, int], weight: np.ndarray) -> np.ndarray:
    """Marker counts (logged), then total weight per word, distinct markers, marker rate, length."""
    seen = np.zeros(len(at))
    for w, times in Counter(words).items():
        for t in tokens_of(w):
            k = at.get(t)
            if k is not None:
                seen[k] += times
    n, hits = len(words), seen.sum()
    return np.concatenate([np.log1p(seen), [seen @ weight / (n + 20), (seen > 0).sum(), hits / (n + 20), np.log1p(n)]])


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, max_rows: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id``, ``text``, ``y`` of about ``max_rows`` labelled rows, chosen by a hash of the id.

    The held-out quarter of ids, NULL labels and contradicting labels are left out.
    """
    from hotsets.llm.quality import held_out

    marks = (labels.select(quoted("doc_id").alias("doc_id"), quoted(label_col).cast("int").alias("y")).where("y in (0, 1)")
             .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z").where(~held_out(F.col("doc_id"))))
    total = marks.count()
    chosen = marks.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(int(1_000_000 * min(1.0, max_rows / max(total, 1)))))
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    # bounded by max_rows, whatever the size of the tables
    return src.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id", "text"])


def learn_markers(sample: DataFrame, markers: int = MARKERS, min_docs: int = 3) -> dict[bytes, float]:
    """The tokens that speak most for the label, with the log odds of their document frequencies.

    Ranked by the likelihood ratio of the label's share among documents with and without the
    token; a beginning that only ever comes with one chosen longer token is passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words, ys = [], []
            for t, y in zip(b.column("text"), b.column("y")):
                own = {x for w in set(words_of(t.as_py())) for x in tokens_of(w)}
                words += own
                ys += [y.as_py()] * len(own)
            yield pa.record_batch([pa.array(words, pa.binary()), pa.array(ys, pa.int32())], ["w", "y"])

    total = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    if not n1 or not n0:
        return {}
    counts = map_batches(sample.select("text", "y"), run, "w binary, y int").groupBy("w").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    a, b, share = F.col("a"), F.col("n") - F.col("a"), n1 / (n1 + n0)

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    ratio = part(a, F.col("n") * share) + part(b, F.col("n") * (1 - share)) + part(n1 - a, (n1 + n0 - F.col("n")) * share) + part(n0 - b, (n1 + n0 - F.col("n")) * (1 - share))
    odds = F.log((a + 0.5) / (n1 - a + 0.5)) - F.log((b + 0.5) / (n0 - b + 0.5))
    best = counts.where((a >= min_docs) & (a * n0 > b * n1)).select("w", "a", "n", ratio.alias("ratio"), odds.alias("odds")).where("ratio > 5")
    chosen: dict[bytes, float] = {}
    same: dict[tuple[int, int], list[bytes]] = {}
    for r in best.orderBy(F.desc("ratio"), F.desc(F.length("w")), "w").limit(4 * markers).collect():
        w = bytes(r["w"])
        alike = same.setdefault((r["a"], r["n"]), [])
        if len(chosen) < markers and not any(x.lstrip(b"^").startswith(w.lstrip(b"^")) and not w.startswith(b"~") for x in alike):
            chosen[w] = float(r["odds"])
            alike.append(w)
    return chosen


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    max_rows: int = TRAIN_ROWS, markers: int = MARKERS) -> DataFrame:
    """``doc_id`` and one probability per category of ``CHAIN``, for every row of ``docs``.

    The models are fitted on about ``max_rows`` labelled rows.  The categories are read from the
    label and the marker words learned there: ``varied`` (toxic, with at least the toxic median
    of different markers), ``dense`` (toxic, with at least the toxic median rate of markers) and
    ``toxic`` itself, which reads the other two.  NULL and empty texts get the score of a text
    without markers; repeated rows get equal scores; without rows of both labels, or without
    markers, all scores are the share of toxic rows, (ones + 0.5) / (rows + 1), 0 without rows.
    """
    src = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    sample = handoff(training_sample(docs, labels, label_col, max_rows, id_col, text_col))
    words = learn_markers(sample, markers)
    at = {w: k for k, w in enumerate(words)}
    weight = np.array([max(v, 0.0) for v in words.values()])

    def rows_of(batch: pa.RecordBatch) -> np.ndarray:
        return np.array([_features(words_of(t.as_py()), at, weight) for t in batch.column("text")]).reshape(-1, len(at) + 4)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column("y"), pa.array(rows_of(b).tolist(), pa.list_(pa.float64())), b.column("fold")], ["y", "x", "fold"])

    fold = F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(_FOLDS)).cast("int").alias("fold")
    fitted = map_batches(sample.select("text", "y", fold), train, "y int, x array<double>, fold int").toArrow()  # bounded by max_rows
    y = fitted.column("y").to_numpy().astype(float)
    chain, flat = None, (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
    if at and 0 < y.sum() < len(y):
        x = np.array(fitted.column("x").to_pylist())
        varied, rate = x[:, -3], x[:, -2]
        target = np.column_stack([y * (varied >= np.median(varied[y == 1])), y * (rate >= np.median(rate[y == 1])), y])
        chain = fit_chain(x, target, fitted.column("fold").to_numpy())

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = chain.probabilities(rows_of(b)) if chain else np.full((b.num_rows, len(CHAIN)), flat)
            yield pa.record_batch([b.column("doc_id")] + [pa.array(p[:, k]) for k in range(len(CHAIN))], ["doc_id", *CHAIN])

    return map_batches(src, score, f"doc_id {kind}, " + ", ".join(f"{c} double" for c in CHAIN))
