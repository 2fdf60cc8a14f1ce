"""Quality scores by histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, lean, remainder, slices, texts_of

UPPER, LOWER, DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789"
SYMBOLS, STOPS, HIGH = b"#*$%&|<>", b".,;:?", bytes(range(128, 256))

FEATURES = (
    "log_words", "word_length", "longest_word", "distinct_words", "distinct_triples", "top_word", "dup_lines", "words_per_line",
    "upper", "digits", "symbols", "stops", "bangs", "high", "ends_in_stop", "words_with_symbol", "capitals", "short_words",
)


def statistics(text: bytes) -> list[float]:
    """FEATURES of one whole text; all zero without a word."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = len(text)
    share = lambda chars: (size - len(text.translate(None, chars))) / size
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    triples = len(set(zip(words, words[1:], words[2:]))) / (n - 2) if n > 2 else 1.0
    marked = [w for w in counts if w.translate(None, SYMBOLS) != w]
    capital = sum(k for w, k in counts.items() if 65 <= w[0] <= 90)
    return [
        float(np.log1p(n)), float(lengths.mean()), float(np.log1p(lengths.max())), len(counts) / n, triples, max(counts.values()) / n,
        1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))), share(UPPER), share(DIGIT), share(SYMBOLS), share(STOPS), share(b"!"), share(HIGH),
        float(text.rstrip()[-1:] in b".!?"), sum(counts[w] for w in marked) / n, capital / n, float((lengths <= 3).mean()),
    ]


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): statistics of each whole text, however long; a null text counts as empty. Repeated rows and rows
    without an id are kept, other columns are ignored, and ties between words don't matter to any statistic."""

    def run(batches):
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts_of(batch.column(1))], np.float32).reshape(-1)
            offsets = pa.array(np.arange(0, len(x) + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x))], ["id", "x"])

    lean(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, x array<float>")


@dataclass
class Trees:
    """A boosted ensemble flattened into arrays: trees x nodes, node k's children are 2k+1 and 2k+2.

    A node without a split sends all rows left (feature 0, cut +inf), so that every path has the
    same depth and the traversal has no branches.
    """

    prior: float
    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.prior)
        rows = np.arange(len(x))
        depth = (self.feature.shape[1] + 1).bit_length() - 1 if self.feature.size else 0
        for feature, at, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > at[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, least: int = 20, ridge: float = 1.0) -> Trees:
    """Level-wise boosting of the logistic loss; splits come from histograms over quantile bins.

    y may lie between 0 and 1. Without rows the ensemble is a constant one half; without two
    classes it has no trees.
    """
    n, width = x.shape
    inner, leaves = 2**depth - 1, 2**depth
    mean = (float(y.sum()) + 0.5) / (n + 1)
    model = Trees(float(np.log(mean / (1 - mean))), np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    if n < 2 * least or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    flat = code + np.arange(width) * bins
    total = np.full(n, model.prior)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)
        feature, at, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            place = ((node - first)[:, None] * (width * bins) + flat).reshape(-1)
            sums = [np.bincount(place, np.repeat(v, width), count * width * bins).reshape(count, width, bins).cumsum(2) for v in (g, h, np.ones(n))]
            (gl, hl, nl), (ga, ha, na) = sums, [s[:, :, -1:] for s in sums]
            gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
            gain[(nl < least) | (na - nl < least)] = -np.inf
            best = gain.reshape(count, -1).argmax(1)
            for k, b in enumerate(best.tolist()):
                j, c = divmod(b, bins)
                if gain[k, j, c] > 1e-6 and c < len(edges[j]):
                    feature[first + k], at[first + k] = j, edges[j][c]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > at[node])
        end = node - inner
        leaf = rate * np.bincount(end, g, leaves) / (np.bincount(end, h, leaves) + ridge)
        total += leaf[end]
        found.append((feature, at, leaf))
    return Trees(model.prior, *map(np.array, zip(*found)))


def train(stats: DataFrame, labels: DataFrame, label_col: str = "quality", rows: int = 20_000, seed: int = 3) -> Trees:
    """Trees from about `rows` labelled rows, by a hash of the id, that are not held out (crc32 mod 4 is 2); never
    from over twice as many, however often an id repeats among the texts.

    Several labels of one document count as their mean; null labels and ids count as none.
    """
    known = labels.where(F.col(label_col).isNotNull() & (remainder(F.col("doc_id"), 4) != 2) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.avg(label_col).alias("y"))
    share = rows / max(1, known.count())
    spot = F.xxhash64(F.lit(seed), "id").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    known = known.withColumn("spot", spot).where(F.col("spot") < share)
    found = stats.join(known, "id").orderBy("spot", "id", "x").limit(2 * rows).select("id", "x", "y").toArrow()
    x = np.array(found.column("x").to_pylist(), np.float32).reshape(-1, len(FEATURES)).astype(float)
    return fit(x, found.column("y").to_numpy())


def score(stats: DataFrame, model: Trees) -> DataFrame:
    """(id, score) by vectorised traversal of the flattened trees, a row for each row of stats, repeated ones too."""

    def run(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES)).astype(float)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.predict(x))], ["id", "score"])

    return stats.select("id", "x").mapInArrow(run, "id long, score double")


def op5_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents; each text is read once, for its statistics."""
    stats = cut(features(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    model = train(stats, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(stats, model).select(
        F.col("id").alias("doc_id"), (remainder(F.col("id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted")
    )
