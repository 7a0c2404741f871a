"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance of the statistics, shrunk towards the pooled covariance and its diagonal.
A score is the logistic of the difference of the two Gaussian log densities, each a Mahalanobis distance through
a cached Cholesky factor. Means and covariances come from sums that the tasks return, one row for each class and
task, so all labelled rows count.

Defined cases: a null text is the empty text and is scored like any other; labels other than 0 and 1, and null
ones, train nothing; a document labelled both ways counts in both; when a class has no training row every score
is 0.5 (predicted 1). Rows without a doc_id train nothing: the query leaves them out, `good_documents` keeps them.
Rows that share a doc_id are each scored; `good_documents` drops them all if it rejects one. Other columns are not
read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage, table, unstage

TO_POOLED, TO_DIAGONAL, RIDGE = 0.3, 0.1, 1e-3
#: log-density differences are divided by this before the logistic, as the statistics are far from independent
TEMPERATURE = 4.0
NAMES = (
    "log_words", "log_lines", "letters", "upper", "digits", "marks", "symbols", "space", "word_length", "spread_of_length", "distinct_words",
    "top_word", "distinct_lines", "words_with_marks_inside", "words_ending_plainly", "sentence_length", "compressed",
)
_MARKED = re.compile(r"[^\w\s.,;:'\"-]")


def statistics(text: str) -> list[float]:
    """Transformed statistics of one whole text: shares as arc sines, counts as logarithms."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(NAMES)
    share = lambda k, of: float(np.arcsin(np.sqrt(min(1.0, k / max(of, 1)))))
    raw = text.encode()
    byte = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, lower, digits = int(byte[65:91].sum()), int(byte[97:123].sum()), int(byte[48:58].sum())
    beyond = chars - int(byte[:128].sum())
    marks = int(byte[[33, 34, 39, 44, 45, 46, 58, 59, 63]].sum())
    space = int(byte[[9, 10, 11, 12, 13, 32]].sum())
    symbols = max(0, chars - upper - lower - digits - beyond - marks - space)
    lengths = np.fromiter(map(len, words), float, n)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split("\n") if x]
    return [
        float(np.log1p(n)), float(np.log1p(len(lines))), share(upper + lower + beyond, chars), share(upper, upper + lower + 1), share(digits, chars), share(marks, chars), share(symbols, chars), share(space, chars),
        float(np.log(lengths.mean())), float(np.log1p(lengths.std())), share(len(counts), n) * min(1.0, np.log1p(n) / 8), share(max(counts.values()), n), share(len(set(lines)), len(lines)),
        share(sum(_MARKED.search(w) is not None for w in words), n), share(sum(w[-1] in ".,;:?" for w in words), n), float(np.log1p(n / (1 + byte[46] + byte[63]))), float(np.log(len(zlib.compress(raw, 1)) / len(raw))),
    ]


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([statistics(t or "") for t in batch["text"].to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])


def described(docs: DataFrame) -> DataFrame:
    """doc_id and statistics x of each row of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_statistics, "doc_id long, x array<double>")


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        y = np.array(batch["label"].to_pylist())
        x = np.array(batch["x"].to_pylist(), float).reshape(len(y), -1)
        x = np.hstack([np.ones((len(y), 1)), x])
        for c in np.unique(y):
            sums[int(c)] = sums.get(int(c), 0) + x[y == c].T @ x[y == c]
    yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([s.ravel().tolist() for s in sums.values()], pa.list_(pa.float64()))], ["label", "m"])


class Discriminant:
    """Two Gaussians with cached Cholesky factors; None for a class without training rows."""

    def __init__(self, moments: dict[int, np.ndarray]):
        self.classes = None
        if not {0, 1} <= moments.keys():
            return
        count = {c: m[0, 0] for c, m in moments.items()}
        mean = {c: m[0, 1:] / m[0, 0] for c, m in moments.items()}
        scatter = {c: m[1:, 1:] - np.outer(mean[c], mean[c]) * m[0, 0] for c, m in moments.items()}
        pooled = (scatter[0] + scatter[1]) / (count[0] + count[1])
        self.classes = []
        for c in (0, 1):
            cov = (1 - TO_POOLED) * scatter[c] / count[c] + TO_POOLED * pooled
            cov = (1 - TO_DIAGONAL) * cov + TO_DIAGONAL * np.diag(np.diag(cov)) + RIDGE * np.eye(len(cov))
            factor = np.linalg.cholesky(cov)
            self.classes.append((mean[c], np.linalg.inv(factor), np.log(np.diag(factor)).sum(), np.log(count[c] / (count[0] + count[1]))))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.full(len(x), 0.5)
        density = [p - d - 0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) for mean, inverse, d, p in self.classes]
        return 1 / (1 + np.exp(-np.clip((density[1] - density[0]) / TEMPERATURE, -500, 500)))


def fit(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fits on stats (doc_id, x) joined with labels (doc_id, label)."""
    rows = stats.join(labels.filter("label in (0, 1)"), "doc_id").select("label", "x").mapInArrow(_moments, "label int, m array<double>")
    rows = rows.select("label", F.posexplode("m")).groupBy("label", "pos").agg(F.sum("col")).collect()
    found: dict[int, dict[int, float]] = {}
    for label, pos, value in rows:
        found.setdefault(label, {})[pos] = value
    width = len(NAMES) + 1
    return Discriminant({c: np.array([v[i] for i in range(width * width)]).reshape(width, width) for c, v in found.items()})


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch["x"].to_pylist(), float).reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(x) if len(x) else np.zeros(0))], ["doc_id", "score"])

    return stats.select("doc_id", "x").mapInArrow(score, "doc_id long, score double").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def trained(spark: SparkSession, docs: DataFrame, sf_dir: str) -> tuple[DataFrame, Discriminant]:
    """Statistics of docs, staged, and a model of the training rows among them."""
    stats = stage(described(docs))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label")).filter(F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    return stats, fit(stats, labels)


def op5_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats, model = trained(spark, table(spark, sf_dir, "documents").filter("doc_id is not null"), sf_dir)
    out = scored(stats, model).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False)))
    return out.select("doc_id", "held_out", "score", "predicted")


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows of docs that the classifier accepts, with all their columns; rows without a doc_id stay."""
    stats, model = trained(spark, docs, sf_dir)
    bad = stage(scored(stats, model).filter("predicted = 0").select("doc_id").distinct())
    unstage(stats)
    # the rejected ones grow with the input: a merge join at every size
    return docs.join(bad.hint("merge"), "doc_id", "left_anti")
