"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic gradient boosting of shallow trees, one feature at a time, fills a
look-up table for each feature; then trees on two features fill tables for the
pairs that explain most of what is left. A score is the logistic function of
an intercept plus one table entry a feature and a pair.

Defined results: null and empty texts have all features 0 and are scored like
any other; a text of any length is read whole. Without labelled rows the score
is 0.5. Repeated rows get equal scores; of an id with several labels the lowest
counts, and of its texts the smallest teaches. A score of exactly the threshold
is 1. An empty table gives an empty result. Inputs are the text alone; kept
columns named like a result are replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField

from .common import Texts, annotate, hash_sample, sum_by_row

FEATURES = ("log_words", "bytes_per_word", "upper_share", "symbols_per_word", "bars_per_word", "exclamations_per_word", "digits_per_word", "stops_per_word", "distinct_words", "distinct_lines", "top_word", "words_per_line", "other_scripts")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def marks(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


UPPER, LOWER, DIGIT = marks(bytes(range(65, 91))), marks(bytes(range(97, 123))), marks(b"0123456789")
SYMBOL, BAR, EXCLAMATION, STOP = marks(b"#*$%&<>"), marks(b"|"), marks(b"!"), marks(b".,;:?")


def word_starts(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """1 where a word begins; a row's first byte begins anew."""
    space = SPACE[data]
    before = np.empty(len(data), bool)
    if len(data):
        before[0] = True
        before[1:] = space[:-1]
        before[start[start < len(data)]] = True
    return ~space & before


def features(texts: Texts) -> np.ndarray:
    """A row of FEATURES for each text."""
    data, n = texts.data, len(texts)
    per = lambda mask: sum_by_row(texts, mask[data]).astype(float)
    words = sum_by_row(texts, word_starts(data, texts.start)).astype(float)
    some = np.maximum(words, 1)
    upper, lower = per(UPPER), per(LOWER)
    distinct, lines_distinct, top, lines = np.zeros(n), np.zeros(n), np.zeros(n), np.zeros(n)
    for i, raw in enumerate(texts):
        count = Counter(raw.split())
        own = [x for x in raw.split(b"\n") if x.strip()]
        distinct[i], top[i] = len(count), max(count.values(), default=0)
        lines[i], lines_distinct[i] = len(own), len(set(own))
    return np.stack([
        np.log1p(words), (texts.size - per(SPACE)) / some, upper / np.maximum(1, upper + lower), per(SYMBOL) / some, per(BAR) / some, per(EXCLAMATION) / some, per(DIGIT) / some, per(STOP) / some,
        distinct / some, lines_distinct / np.maximum(1, lines), top / some, np.log1p(words / np.maximum(1, lines)), sum_by_row(texts, data >= 128) / np.maximum(1, texts.size),
    ], axis=1)


@dataclass
class AdditiveModel:
    """cuts[f]: bin borders; tables[f]: a value for each bin; pairs: (i, j, borders of i, of j, table)."""

    intercept: float = 0.0
    cuts: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple] = field(default_factory=list)

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for f, (cut, table) in enumerate(zip(self.cuts, self.tables, strict=True)):
            z += table[np.searchsorted(cut, x[:, f], side="right")]
        for i, j, a, b, table in self.pairs:
            z += table[np.searchsorted(a, x[:, i], side="right"), np.searchsorted(b, x[:, j], side="right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def best_cut(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[float, int]:
    """Gain and place of the best split of sums of gradients g and curvatures h in order of bins; gain 0: none."""
    if len(g) < 2:
        return 0.0, 0
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    all_g, all_h = g.sum(), h.sum()
    gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, leaves: int = 3, ridge: float = 2.0) -> np.ndarray:
    """A step for each bin: the bins are split greedily into a few ranges."""
    ranges = [(0, len(g))]
    while len(ranges) < leaves:
        gains = [(*best_cut(g[a:b], h[a:b], ridge), k) for k, (a, b) in enumerate(ranges)]
        gain, at, k = max(gains)
        if gain <= 1e-9:
            break
        a, b = ranges.pop(k)
        ranges += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in ranges:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + ridge)
    return out


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 2.0) -> tuple[float, np.ndarray]:
    """Gain and step of a tree that splits the first feature once and each side by the second."""
    best = (0.0, np.zeros_like(g))
    for a in range(1, g.shape[0]):
        out, gain = np.zeros_like(g), 0.0
        for side in (slice(0, a), slice(a, None)):
            gs, hs = g[side].sum(axis=0), h[side].sum(axis=0)
            own, at = best_cut(gs, hs, ridge)
            gain += own
            for part in (slice(0, at), slice(at, None)):
                out[side, part] = -gs[part].sum() / (hs[part].sum() + ridge)
        if gain > best[0]:
            best = (gain, out)
    return best


def train(x: np.ndarray, y: np.ndarray, rounds: int = 120, rate: float = 0.15, bins: int = 48, n_pairs: int = 4, pair_rounds: int = 30, pair_bins: int = 8) -> AdditiveModel:
    if not len(y):
        return AdditiveModel(0.0, [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1])
    mean = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = AdditiveModel(float(np.log(mean / (1 - mean))))
    at = []
    for f in range(x.shape[1]):
        cut = np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1]))
        model.cuts.append(cut)
        model.tables.append(np.zeros(len(cut) + 1))
        at.append(np.searchsorted(cut, x[:, f], side="right"))
    z = np.full(len(y), model.intercept)
    slopes = lambda: ((p := 1 / (1 + np.exp(-z))) - y, np.maximum(p * (1 - p), 1e-6))
    for _ in range(rounds):
        for f, own in enumerate(at):
            g, h = slopes()
            size = len(model.tables[f])
            step = rate * shallow_tree(np.bincount(own, g, size), np.bincount(own, h, size))
            model.tables[f] += step
            z += step[own]
    coarse = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, pair_bins + 1)[1:-1])) for f in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, f], side="right") for f, c in enumerate(coarse)]
    found = []
    grid = lambda i, j, v: np.bincount(small[i] * (len(coarse[j]) + 1) + small[j], v, (len(coarse[i]) + 1) * (len(coarse[j]) + 1)).reshape(len(coarse[i]) + 1, -1)
    g, h = slopes()
    for i in range(x.shape[1]):
        for j in range(i + 1, x.shape[1]):
            found.append((pair_tree(grid(i, j, g), grid(i, j, h))[0], i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for _, i, j in sorted(found, reverse=True)[:n_pairs]]
    for _ in range(pair_rounds):
        for i, j, total in chosen:
            g, h = slopes()
            step = rate * pair_tree(grid(i, j, g), grid(i, j, h))[1]
            total += step
            z += step[small[i], small[j]]
    model.pairs = [(i, j, coarse[i], coarse[j], total) for i, j, total in chosen]
    return model


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 20_000) -> AdditiveModel:
    """A model from about max_rows labelled documents (the bound on the broadcast sample, and on what comes to the driver)."""
    # an id with several labels counts once, with the lowest
    own = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id")).agg(F.min(label_col).alias("label_y"))
    sample = hash_sample(own, ["label_id"], max_rows)
    # of an id's texts one: the smallest (a partial aggregate, however often an id occurs)
    joined = docs.select(F.col(id_col).alias("label_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "label_id").groupBy("label_id").agg(F.min("text").alias("text"), F.min("label_y").alias("label_y"))

    def start():
        return lambda batch: [pa.array(list(features(Texts(batch.column("text")))), pa.list_(pa.float64()))]

    rows = annotate(joined, [StructField("x", ArrayType(DoubleType()))], start, ["text"], ["label_id", "label_y"]).collect()
    rows.sort(key=lambda r: (r["label_id"], r["label_y"], r["x"]))
    return train(np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES)), np.array([float(r["label_y"]) for r in rows]))


def classify(df: DataFrame, model: AdditiveModel, text_col: str = "text", threshold: float = 0.3, keep: list[str] | None = None, score_out: str = "score", verdict_out: str = "predicted") -> DataFrame:
    """keep (default: all columns of df), score, and 1 where it reaches threshold."""

    def start():
        def f(batch: pa.RecordBatch) -> list:
            score = model.score(features(Texts(batch.column(text_col))))
            return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

        return f

    return annotate(df, [StructField(score_out, DoubleType()), StructField(verdict_out, IntegerType())], start, [text_col], df.columns if keep is None else keep, text_col)
