"""Toxicity by classifier chains."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hash60, small
from .quality import FEATURES, statistics

#: Most labelled keys that are learned from for each combination of categories: those with the lowest hashes.
SAMPLE = 3000
#: Tokens that a category's model uses, and documents that a token must be in.
TOKENS, LEAST = 300, 5
FOLDS = 5
#: Strength of the penalty on weights.
PENALTY = 2.0
HELD_OUT = 2

_LETTERS = re.compile(r"[^\W\d_]+")


def tokens_of(word: str) -> list[str]:
    """A word, and its beginnings of 4 to 7 letters where it goes on."""
    return [word, *(f"{word[:k]}-" for k in range(4, min(8, len(word))))]


def counts_of(text: str | None) -> Counter:
    return Counter(_LETTERS.findall((text or "").lower()))


class Features:
    """Rows of numbers from texts: statistics, then for each token the square root of its share of the words."""

    def __init__(self, tokens: list[str]):
        self.tokens = {t: len(FEATURES) + i for i, t in enumerate(tokens)}
        self._of_word: dict[str, list[int]] = {}

    def row(self, text: str | None) -> np.ndarray:
        words = counts_of(text)
        out = np.zeros(len(FEATURES) + len(self.tokens))
        out[: len(FEATURES)] = statistics(text)
        for word, n in words.items():
            ids = self._of_word.get(word)
            if ids is None:
                if len(self._of_word) > 500_000:
                    self._of_word.clear()
                ids = self._of_word[word] = [self.tokens[t] for t in tokens_of(word) if t in self.tokens]
            for i in ids:
                out[i] += n
        total = max(1, sum(words.values()))
        out[len(FEATURES) :] = np.sqrt(out[len(FEATURES) :] / total)
        return out


@dataclass
class Link:
    """A linear model over some columns of the features, standardised, and the probabilities of the links before it."""

    columns: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def predict(self, x: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        z = (x[:, self.columns] - self.center) / self.scale
        return _sigmoid(np.hstack((z, earlier)) @ self.weights[1:] + self.weights[0])


@dataclass
class Chain:
    """Linear models in order: each sees the statistics, its tokens and the probabilities of those before it."""

    features: Features
    links: list[Link]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """The probabilities of the categories for rows of features."""
        found = np.zeros((len(x), 0))
        for link in self.links:
            found = np.hstack((found, link.predict(x, found)[:, None]))
        return found


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weights (the constant first) of a penalised logistic model, by Newton's method; w: weights of rows."""
    x1 = np.hstack((np.ones((len(x), 1)), x))
    prior = (w @ y + 1) / (w.sum() + 2)
    beta = np.zeros(x1.shape[1])
    beta[0] = np.log(prior / (1 - prior))
    penalty = np.full(x1.shape[1], PENALTY)
    penalty[0] = 1e-6
    for _ in range(30):
        p = _sigmoid(x1 @ beta)
        gradient = x1.T @ (w * (y - p)) - penalty * beta
        hessian = (x1 * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1 + np.diag(penalty)
        step = np.linalg.solve(hessian, gradient)
        beta += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return beta


def train_link(x: np.ndarray, earlier: np.ndarray, y: np.ndarray, w: np.ndarray, columns: list[int]) -> Link:
    """A model whose columns are standardised over the rows that it learns from."""
    part = x[:, columns].astype(float)
    center = part.mean(axis=0) if len(x) else np.zeros(len(columns))
    scale = np.maximum(part.std(axis=0), 1e-3) if len(x) else np.ones(len(columns))
    return Link(np.array(columns), center, scale, train_linear(np.hstack(((part - center) / scale, earlier)), y, w))


def train_chain(x: np.ndarray, y: np.ndarray, w: np.ndarray, fold: np.ndarray, chosen: dict[tuple[int, int], list[int]]) -> list[Link]:
    """Fits each category in turn. A later model learns from out-of-fold probabilities of earlier ones, so it sees them
    as good or bad as they are on new texts.

    chosen: the columns of (category, fold), with FOLDS as the fold that is all rows. Columns of a fold were chosen,
    and are standardised, without the rows of the fold.
    """
    earlier, links = np.zeros((len(x), 0)), []
    for k in range(y.shape[1]):
        links.append(train_link(x, earlier, y[:, k], w, chosen[k, FOLDS]))
        out_of_fold = np.zeros(len(x))
        for f in range(FOLDS):
            test = fold == f
            if test.any():
                link = train_link(x[~test], earlier[~test], y[~test, k], w[~test], chosen[k, f])
                out_of_fold[test] = link.predict(x[test], earlier[test])
        earlier = np.hstack((earlier, out_of_fold[:, None]))
    return links


def sample(df: DataFrame, labels: DataFrame, categories: dict[str, str], key: str, text: str) -> tuple[DataFrame, dict[int, int]]:
    """(_h, _code, _fold, _t) of at most SAMPLE labelled keys for each combination of categories, and how many keys each has.

    A key counts once, whatever rows it has: the text with the smallest hash stands for it. Folds go by the text, so
    copies are in one fold.
    """
    rows = labels.where(F.col(key).isNotNull() & (F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(4)) != HELD_OUT))
    code = sum((F.when(F.expr(c), F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate(categories.values())), F.lit(0))
    rows = rows.select(F.col(key).alias("_key"), code.alias("_code")).groupBy("_key").agg(F.bit_or("_code").alias("_code"))
    rows = cut(rows.withColumn("_h", hash60(F.lit("chain"), "_key")))
    totals = {r["_code"]: r["n"] for r in rows.groupBy("_code").agg(F.count("*").alias("n")).collect()}  # at most 2 ** categories
    picked = None
    for value in sorted(totals):
        part = rows.where(F.col("_code") == value).orderBy("_h", "_key").limit(SAMPLE)
        picked = part if picked is None else picked.union(part)
    picked = cut(rows.limit(0) if picked is None else picked)
    texts = df.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_t")).join(small(picked), "_key")
    one = texts.groupBy("_key", "_h", "_code").agg(F.min_by("_t", F.struct(F.xxhash64("_t"), "_t")).alias("_t"))
    fold = F.pmod(F.coalesce(F.crc32(F.col("_t").cast("binary")), F.lit(0)), F.lit(FOLDS)).cast("int")
    return cut(one.select("_h", "_code", fold.alias("_fold"), "_t")), totals


def choose(texts: DataFrame, n_categories: int) -> dict[tuple[int, int], list[str]]:
    """For each category and fold, the TOKENS that tell it best from the rest, by the rows outside the fold; FOLDS: by all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            for t, code, fold in zip(*(batch.column(c).to_pylist() for c in ("_t", "_code", "_fold")), strict=True):
                found.update((token, code, fold) for token in {t for word in counts_of(t) for t in tokens_of(word)})
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in found], pa.string()), pa.array([k[1] for k in found], pa.int32()), pa.array([k[2] for k in found], pa.int32()), pa.array(list(found.values()), pa.int64())], names=["token", "code", "fold", "n"])

    seen = texts.select("_t", "_code", "_fold").mapInArrow(count, "token string, code int, fold int, n long")
    has = lambda k: F.col("code").bitwiseAND(F.lit(1 << k)) != 0
    some = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).alias
    sums = [some(F.col("fold") != f)(f"d_{f}") for f in range(FOLDS + 1)] + [some(has(k) & (F.col("fold") != f))(f"p{k}_{f}") for k in range(n_categories) for f in range(FOLDS + 1)]
    # a table that the sample bounds: few parts, so that few rows of each meet for the best ones
    tokens = cut(seen.groupBy("token").agg(*sums).where(F.col(f"d_{FOLDS}") >= LEAST).coalesce(16))
    rows = [(r["_code"], r["_fold"], r["n"]) for r in texts.groupBy("_code", "_fold").agg(F.count("*").alias("n")).collect()]
    best = None
    for k in range(n_categories):
        for f in range(FOLDS + 1):
            pos = sum(n for c, g, n in rows if g != f and c >> k & 1)
            neg = sum(n for c, g, n in rows if g != f and not c >> k & 1)
            if not pos or not neg:
                continue
            d, p = F.col(f"d_{f}"), F.col(f"p{k}_{f}")
            share, p1, p0 = d / (pos + neg), p / pos, (d - p) / neg
            z = F.abs((p1 - p0) / F.sqrt(share * (1 - share) * (1 / pos + 1 / neg) + 1e-9))
            part = tokens.where(d >= LEAST).select(F.lit(k).alias("k"), F.lit(f).alias("f"), "token", z.alias("z")).orderBy(F.desc("z"), "token").limit(TOKENS)
            best = part if best is None else best.union(part)
    found = [] if best is None else sorted(best.collect(), key=lambda r: (r.k, r.f, -r.z, r.token))  # TOKENS for each category and fold
    return {(k, f): [r.token for r in found if (r.k, r.f) == (k, f)] for k in range(n_categories) for f in range(FOLDS + 1)}


def fit(df: DataFrame, labels: DataFrame, categories: dict[str, str], key: str, text: str) -> Chain:
    """A chain from labelled rows outside the held-out part; categories: name -> SQL condition over labels.

    What reaches the driver is bounded: the features of the sample, and the tokens that were chosen.
    """
    texts, totals = sample(df, labels, categories, key, text)
    chosen = choose(texts, len(categories))
    tokens = sorted({t for some in chosen.values() for t in some})
    wide = Features(tokens)

    def feature(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.float32(wide.row(t)).tobytes() for t in batch.column("_t").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_h", "_code", "_fold")), pa.array(data, pa.binary())], names=["_h", "_code", "_fold", "x"])

    got = texts.mapInArrow(feature, "_h long, _code int, _fold int, x binary").toArrow()
    stats = list(range(len(FEATURES)))
    if not got.num_rows:
        empty = [Link(np.array(stats), np.zeros(len(stats)), np.ones(len(stats)), np.zeros(1 + len(stats) + k)) for k in range(len(categories))]
        return Chain(Features([]), empty)
    data = got.column("x").to_pylist()
    order = np.array(sorted(range(got.num_rows), key=lambda i: (got.column("_h")[i].as_py(), data[i])), int)
    x = np.stack([np.frombuffer(data[i], np.float32) for i in order])
    code, fold = got.column("_code").to_numpy()[order], got.column("_fold").to_numpy()[order]
    y = np.stack([(code >> k & 1).astype(float) for k in range(len(categories))], 1)
    share = {c: totals[c] / n for c, n in Counter(code.tolist()).items()}
    w = np.array([share[c] for c in code.tolist()])
    links = train_chain(x, y, w / w.mean(), fold, {at: stats + [wide.tokens[t] for t in some] for at, some in chosen.items()})
    # what scores needs the columns of the links alone
    used = sorted({c for link in links for c in link.columns.tolist()} - set(stats))
    place = {c: len(stats) + i for i, c in enumerate(used)}
    for link in links:
        link.columns = np.array([place.get(c, c) for c in link.columns.tolist()])
    return Chain(Features([tokens[c - len(stats)] for c in used]), links)


def score_toxicity(df: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, key: str = "doc_id", text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Scores every whole text for each category, the last of which is the verdict.

    categories: name -> SQL condition over the columns of labels, in the order of the chain; by default low quality,
    then toxic. Returns the key, held_out, p_<name> for each category and toxic (the last probability reaches the
    threshold). Labels whose key's crc32 has remainder 2 by 4 are never learned from.

    Null and empty texts are scored by their zero features. Null labels count as no; a key with several label rows
    has a category if one of them has it, and one with several texts is learned from once; null keys aren't learned from. Without labels all probabilities are 0.5 and
    toxic is false. Repeated rows stay. An empty table gives an empty result. Other columns are left out.
    """
    categories = categories or {"low_quality": "quality = 0", "toxic": "toxic = 1"}
    chain = fit(df, labels, categories, key, text)
    base = df.select(F.col(key), F.col(text))
    names = [f"p_{c}" for c in categories]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = batch.column(1), batch.column(0)
            p = np.zeros((batch.num_rows, len(names)))
            for at in range(0, batch.num_rows, 512):
                part = texts.slice(at, 512)
                p[at : at + 512] = chain.predict(np.stack([chain.features.row(t.as_py()) for t in part]))
            held = [zlib.crc32(b"" if k is None else str(k).encode()) % 4 == HELD_OUT for k in keys.to_pylist()]
            yield pa.RecordBatch.from_arrays([keys, pa.array(held, pa.bool_()), *(pa.array(p[:, k]) for k in range(len(names)))], names=[key, "held_out", *names])

    out = base.mapInArrow(run, f"{key} {base.schema[key].dataType.simpleString()}, held_out boolean, " + ", ".join(f"{n} double" for n in names))
    return out.withColumn("toxic", F.col(names[-1]) > threshold)
