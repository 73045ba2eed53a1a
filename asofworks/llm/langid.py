"""Language identification by a byte convolutional network.

A text's UTF-8 bytes are cut into windows of WINDOW bytes, each beginning with
the last three of the one before, so that no run of four bytes is lost between
two. Filters of two, three and four bytes run over each window, their largest
values are kept (max pooling), and a softmax layer turns them into
probabilities. Each text's probabilities are the mean over all its windows.

Defined results: a null text, or one without any letter, is ``und`` with score
0. Without labelled rows every text is ``und``. A text of any length is read
whole, by all its windows. Repeated rows get equal results, and rows that share
an id are told apart by their texts alone; ties go to the language first in
alphabetical order. An empty table gives an empty result. Extra columns
are ignored, or kept by ``identify(..., keep=...)``, where an own column named
like a result is replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DoubleType, StringType, StructField

from .common import Texts, annotate, hash_sample

WINDOW = 64
WIDTHS = (2, 3, 4)
STEP = WINDOW - max(WIDTHS) + 1
#: Byte classes: letters without case, white space, digits, other ASCII, and each of UTF-8's other bytes.
CLASSES = 29 + 64 + 51
#: Letters, and numbers that are none by str.isalpha: fractions, Roman numerals.
MAYBE_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in MAYBE_LETTER.finditer(text))


def byte_classes() -> np.ndarray:
    b = np.arange(256)
    out = np.full(256, 28)
    for first in (65, 97):
        out[first : first + 26] = np.arange(26)
    out[[9, 10, 11, 12, 13, 32]] = 26
    out[48:58] = 27
    out[128:192] = 29 + b[:64]
    out[194:245] = 93 + b[:51]
    return out.astype(np.uint8)


BYTE_CLASS = byte_classes()


@dataclass
class ByteCnn:
    """taps[w][o]: what the class at offset o adds to each filter of width w; out, bias: the softmax layer."""

    languages: list[str]
    taps: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    def tables(self) -> list[list[np.ndarray]]:
        """The taps of two neighbouring bytes added up once: fewer look-ups for each position."""
        two = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, -1).astype(np.float32)
        t2, t3, t4 = self.taps
        return [[two(t2[0], t2[1])], [two(t3[0], t3[1]), t3[2].astype(np.float32)], [two(t4[0], t4[1]), two(t4[2], t4[3])]]

    def pooled(self, windows: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        """The largest value of each filter in each window of classes."""
        c = windows.astype(np.intp)
        pair = c[:, :-1] * CLASSES + c[:, 1:]
        best = []
        for width, own in zip(WIDTHS, tables, strict=True):
            n = windows.shape[1] - width + 1
            value = own[0].take(pair[:, :n], axis=0)
            if width == 3:
                value += own[1].take(c[:, 2 : 2 + n], axis=0)
            elif width == 4:
                value += own[1].take(pair[:, 2 : 2 + n], axis=0)
            best.append(value.max(axis=1))
        return np.maximum(np.concatenate(best, axis=1), 0)

    def probabilities(self, windows: np.ndarray, tables: list[list[np.ndarray]], step: int = 128) -> np.ndarray:
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for at in range(0, len(windows), step):  # blocks that stay in the CPU's cache
            z = self.pooled(windows[at : at + step], tables) @ self.out + self.bias
            z = np.exp(z - z.max(axis=1, keepdims=True))
            out[at : at + step] = z / z.sum(axis=1, keepdims=True)
        return out


def windows_of(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """All windows of all texts, filled up with white space, and each window's row."""
    count = np.where(texts.size > 0, 1 + np.maximum(0, -(-(texts.size - WINDOW) // STEP)), 0)
    room = np.where(count > 0, (count - 1) * STEP + WINDOW, 0)
    end = np.cumsum(room)
    out = np.full(max(WINDOW, int(end[-1]) if len(end) else 0), 26, np.uint8)
    for a, b, at in zip(texts.start.tolist(), texts.end.tolist(), (end - room).tolist(), strict=True):
        out[at : at + b - a] = BYTE_CLASS[texts.data[a:b]]
    row = np.repeat(np.arange(len(texts)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[(end - room)[row] + nth * STEP], row


def spread_windows(texts: Texts, per_text: int = 8) -> list[np.ndarray]:
    """Up to per_text windows of each text, evenly spread."""
    x, row = windows_of(texts)
    bounds = np.searchsorted(row, np.arange(len(texts) + 1))
    return [x[np.unique(np.linspace(a, b - 1, per_text).astype(int))] if b > a else x[:0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def train(windows: list[np.ndarray], langs: list[str], filters: int = 16, epochs: int = 6, seed: int = 7) -> ByteCnn:
    """Fits the network by Adam on each text's windows."""
    rng = np.random.default_rng(seed)
    languages = sorted({v for w, v in zip(windows, langs, strict=True) if len(w)})
    places = {v: k for k, v in enumerate(languages)}
    x = np.concatenate([w.reshape(-1, WINDOW) for w in windows]) if windows else np.zeros((0, WINDOW), np.uint8)
    y = np.array([places[v] for w, v in zip(windows, langs, strict=True) for _ in range(len(w))], np.int64)
    scale = 0.3
    net = ByteCnn(languages, [rng.normal(0, scale, (w, CLASSES, filters)) for w in WIDTHS], rng.normal(0, 0.2, (len(WIDTHS) * filters, len(languages))), np.zeros(len(languages)))
    params = [*net.taps, net.out, net.bias]
    m, v, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    weight = np.ones(len(languages))
    if len(y):
        weight = np.sqrt(len(y) / np.maximum(1, np.bincount(y, minlength=len(languages))) / len(languages))
    for _ in range(epochs if len(languages) > 1 else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            own = order[at : at + 256]
            c, target = x[own], y[own]
            values, places = [], []
            for w, tap in zip(WIDTHS, net.taps, strict=True):
                n = WINDOW - w + 1
                value = sum(tap[o].take(c[:, o : o + n], axis=0) for o in range(w))
                place = value.argmax(axis=1)
                places.append(place)
                values.append(np.take_along_axis(value, place[:, None], 1)[:, 0])
            pooled = np.concatenate(values, axis=1)
            hidden = np.maximum(pooled, 0)
            z = hidden @ net.out + net.bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(own)), target] -= 1
            p *= weight[target][:, None] / len(own)
            back = (p @ net.out.T) * (pooled > 0)
            grads = []
            for k, (w, tap) in enumerate(zip(WIDTHS, net.taps, strict=True)):
                g = np.zeros_like(tap)
                part = back[:, k * filters : (k + 1) * filters]
                for o in range(w):
                    cls = np.take_along_axis(c, (places[k] + o).astype(np.int64), 1).astype(np.int64)
                    g[o] = np.bincount((cls * filters + np.arange(filters)).ravel(), part.ravel(), CLASSES * filters).reshape(CLASSES, filters)
                grads.append(g)
            grads += [hidden.T @ p, p.sum(axis=0)]
            step += 1
            for i, g in enumerate(grads):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                params[i] -= 0.01 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 500) -> ByteCnn:
    """A network from about per_language rows of each language. Of each row its windows come to the driver, half a kilobyte at most."""
    rows = hash_sample(labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(id_col, text_col, lang_col), [id_col, text_col], per_language, lang_col)
    f = lambda b: [pa.array([w.tobytes() for w in spread_windows(Texts(b.column(text_col)))], pa.binary())]
    found = annotate(rows, [StructField("_windows", BinaryType())], lambda: f, [text_col], [id_col, lang_col], text_col)
    own = sorted(found.collect(), key=lambda r: (str(r[0]), bytes(r[2])))
    return train([np.frombuffer(r[2], np.uint8).reshape(-1, WINDOW) for r in own], [str(r[1]) for r in own])


def identify(df: DataFrame, net: ByteCnn, text_col: str = "text", keep: list[str] | None = None, lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """keep (default: all columns of df), the predicted language and its probability."""

    def start():
        tables = net.tables() if net.languages else []

        def f(batch: pa.RecordBatch) -> list:
            texts = Texts(batch.column(text_col))
            n = len(texts)
            if not net.languages:
                return [pa.array(["und"] * n), pa.array(np.zeros(n))]
            windows, row = windows_of(texts)
            p = net.probabilities(windows, tables)
            count = np.maximum(1, np.bincount(row, minlength=n))
            mean = np.stack([np.bincount(row, p[:, k], n) / count for k in range(p.shape[1])], axis=1)
            best = mean.argmax(axis=1)
            known = np.array([has_letter(s) for s in texts.strings()], bool)
            names = [net.languages[b] if k else "und" for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            return [pa.array(names, pa.string()), pa.array(np.where(known, np.clip(mean[np.arange(n), best], 0, 1), 0.0))]

        return f

    return annotate(df, [StructField(lang_out, StringType()), StructField(score_out, DoubleType())], start, [text_col], df.columns if keep is None else keep, text_col)
