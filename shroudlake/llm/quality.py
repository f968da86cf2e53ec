"""A quality classifier: regularised quadratic discriminant over document statistics."""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Transformed statistics of a whole text; none comes from language, source, key or labels.
FEATURES = ["log_words", "log_chars", "word_length", "word_spread", "upper", "symbol", "digit", "end_mark", "other_mark", "non_ascii", "repeat_window", "distinct", "line_words", "dup_line"]
#: Weight of the pooled covariance in each class, and of the diagonal.
POOL, RIDGE = 0.3, 0.05
#: Parts of one in which statistics are summed. They are below 64, so the products of a batch of 10,000 rows fit into 64 bits.
UNIT = 1 << 16
#: A label row stands for the held-out part if crc32 of its key's text has this remainder by 4.
HELD_OUT = 2

_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_SYMBOL = b"#*$%&|<>"
_END = b".!?"
_OTHER = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _SYMBOL + _END)
_HIGH = bytes(range(128, 256))


def statistics(text: str | None) -> list[float]:
    """FEATURES of a text; null counts as empty, and an empty text has finite values."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    n, chars = len(words), sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    share = lambda some, most: math.sqrt(some / most) if most else 0.0
    hit = lambda table: len(raw) - len(raw.translate(None, table))
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    mean = chars / n if n else 0.0
    spread = math.sqrt(max(0.0, sum(k * k * c for k, c in Counter(map(len, words)).items()) / n - mean * mean)) if n else 0.0
    return [
        math.log1p(n), math.log1p(len(raw)), math.log1p(mean), math.log1p(spread), share(hit(_UPPER), chars), share(hit(_SYMBOL), chars), share(hit(_DIGIT), chars), share(hit(_END), n), share(hit(_OTHER), n),
        share(hit(_HIGH), chars), share(sum(c for c in windows.values() if c > 1), max(1, n - 2)), math.log1p(len(set(words))) / math.log(2 + n), math.log1p(n / len(lines)) if lines else 0.0, share(len(lines) - len(set(lines)), len(lines)),
    ]


class Discriminant:
    """Two Gaussian classes with shrunk covariances; the inverses of their Cholesky factors are computed once and kept."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]], center: np.ndarray, scale: np.ndarray):
        """moments: by class, the count, the sum and the sum of outer products of standardised statistics."""
        self.center, self.scale, d = center, scale, len(center)
        total = sum(n for n, _, _ in moments.values())
        pooled = sum((s - np.outer(m, m) / n for n, m, s in moments.values() if n), np.zeros((d, d))) / max(1.0, total - 2)
        self.parts = {}
        for label in (0, 1):
            n, m, s = moments.get(label, (0.0, np.zeros(d), np.zeros((d, d))))
            mean = m / n if n else np.zeros(d)
            own = (s - np.outer(m, m) / n) / max(1.0, n - 1) if n else pooled
            pool = max(POOL, min(1.0, 2 * d / n) if n else 1.0)  # fewer labels, more of the pooled covariance
            cov = (1 - pool) * own + pool * pooled
            cov = (1 - RIDGE) * cov + RIDGE * np.eye(d) * max(np.trace(cov) / d, 1e-3)
            factor = np.linalg.cholesky(cov)
            self.parts[label] = (mean, np.linalg.inv(factor), -np.log(np.diag(factor)).sum() + math.log((n + 1) / (total + 2)))

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of label 1 for rows of statistics."""
        z = (x - self.center) / self.scale
        density = {}
        for label, (mean, whiten, const) in self.parts.items():
            y = (z - mean) @ whiten.T
            density[label] = const - 0.5 * (y * y).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def whole(x: np.ndarray) -> np.ndarray:
    """Statistics as whole multiples of 1 / UNIT, so that their sums are the same in any order."""
    return np.rint(x * UNIT).astype(np.int64)


def moments(rows: DataFrame) -> dict[int, tuple[int, list[int], list[list[int]]]]:
    """By label the count, the sums and the sums of products of whole() statistics, exactly.

    rows: _label and stats. Each batch is summed where it is, in 64 bits; the sums of batches meet as decimals.
    """
    d = len(FEATURES)
    n_sums = 1 + d + d * d

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels = batch.column(0).to_numpy()
            x = whole(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d))
            for label in np.unique(labels).tolist():
                own = x[labels == label]
                sums = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([label], pa.int32()), pa.array([sums.tolist()], pa.list_(pa.int64()))], names=["_label", "sums"])

    parts = rows.select("_label", "stats").mapInArrow(run, "_label int, sums array<long>")
    total = parts.groupBy("_label").agg(F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(n_sums)]).alias("sums"))
    out = {}
    for r in total.collect():  # two rows
        sums = [int(v) for v in r["sums"]]
        out[r["_label"]] = (sums[0], sums[1 : 1 + d], [sums[1 + d * (i + 1) : 1 + d * (i + 2)] for i in range(d)])
    return out


def discriminant(raw: dict[int, tuple[int, list[int], list[list[int]]]]) -> Discriminant:
    """The model of moments()."""
    d = len(FEATURES)
    sums = {k: (float(n), np.array([v / UNIT for v in m]), np.array([[v / UNIT**2 for v in row] for row in s])) for k, (n, m, s) in sorted(raw.items())}
    n = sum(v[0] for v in sums.values())
    center = sum((v[1] for v in sums.values()), np.zeros(d)) / max(n, 1)
    scale = np.sqrt(np.maximum(sum((np.diag(v[2]) for v in sums.values()), np.zeros(d)) / max(n, 1) - center**2, 1e-4))
    standard = {}
    for k, (m_n, m, s) in sums.items():
        shifted = s - np.outer(m, center) - np.outer(center, m) + m_n * np.outer(center, center)
        standard[k] = (m_n, (m - m_n * center) / scale, shifted / np.outer(scale, scale))
    return Discriminant(standard, center, scale)


def fit(features: DataFrame, labels: DataFrame, key: str, label: str) -> Discriminant:
    """The classes' moments over all labelled rows outside the held-out part, and the model of them."""
    learn = labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull()).select(key, F.col(label).cast("int").alias("_label")).distinct()
    return discriminant(moments(features.where(~F.col("held_out")).join(learn, key)))


def score_quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", threshold: float = 0.7) -> DataFrame:
    """Scores every whole text for quality.

    Returns the key, held_out (crc32 of the key's text has remainder 2 by 4), score (probability of label 1) and
    predicted (1 from the threshold on). Only labels outside the held-out part are learned; labels that aren't 0 or 1
    and null keys are left out of learning, and a key with both labels counts for both classes. Null and empty texts
    are scored by their (zero) statistics. A null key counts as the empty text. Repeated rows stay. Without labels
    every score is that of one class alone. Sums are exact, so reruns agree to the bit. An empty table gives an empty
    result. Other columns are left out.
    """
    base = df.select(F.col(key), F.col(text))
    kind = base.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            held = [zlib.crc32(b"" if k is None else str(k).encode()) % 4 == HELD_OUT for k in keys.to_pylist()]
            stats = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([keys, pa.array(held, pa.bool_()), pa.array(stats, pa.list_(pa.float64()))], names=[key, "held_out", "stats"])

    features = cut(base.mapInArrow(run, f"{key} {kind}, held_out boolean, stats array<double>"))
    model = fit(features, labels, key, label)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.score(x), pa.float64())], names=[key, "held_out", "score"])

    scored = features.mapInArrow(score, f"{key} {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
