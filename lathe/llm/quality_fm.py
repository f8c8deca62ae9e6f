"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A text's features are its distinct lower-cased words, hashed (each worth 1 / sqrt of their number),
and one bin of each structure statistic: shares of symbols, capitals, digits, exclamation marks and
repeated neighbours, distinct words, word length, words to a line, repeated lines; and its length as
metadata. The score is linear plus low-rank pairwise terms, in time linear in the features:

    b + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum v_if^2 x_i^2]

trained by Adam on minibatches in numpy, on a bounded sample (`per_class` labelled texts of each
class, weighted back to the shares of the classes), and calibrated on a fifth left out. Scoring
reads whole texts. Ids, languages, sources and labels are not features.

Defined results: null and empty texts have the bins of an empty text; with one class or none among
the labels every score is that class's share (0.5 with none). Extra columns pass through.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.textops import class_sample, utf8

_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))
_DIGITS = bytes(range(48, 58))
_SYMBOLS = b"#*$%&|<>"
#: Upper ends of the bins of each statistic.
BINS = {
    "symbols": (0.001, 0.005, 0.02, 0.05, 0.1, 0.2),
    "capitals": (0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "digits": (0.001, 0.01, 0.05, 0.1, 0.3),
    "exclamations": (0.001, 0.01, 0.05, 0.2, 0.5),
    "neighbours": (0.02, 0.05, 0.1, 0.2, 0.4, 0.6),
    "distinct": (0.1, 0.2, 0.35, 0.5, 0.7, 0.9),
    "word_bytes": (2.5, 3.5, 4.5, 5.5, 7, 9, 12),
    "line_words": (2, 5, 10, 20, 40, 80),
    "same_lines": (0.01, 0.05, 0.1, 0.3, 0.6),
    "length": (20, 60, 200, 600, 2000, 6000, 20000, 60000),
}
_FIRST = np.cumsum([0, *(len(v) + 1 for v in BINS.values())])


def _less(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def features(raw: bytes | None, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, values): structure bins first, then word buckets."""
    raw = raw or b""
    words = raw.split()
    n, size, letters = max(1, len(words)), max(1, len(raw)), max(1, _less(raw, _LETTERS))
    lines = [x for x in raw.split(b"\n") if x]
    stats = (
        _less(raw, _SYMBOLS) / size,
        _less(raw, _UPPER) / letters,
        _less(raw, _DIGITS) / size,
        _less(raw, b"!") / n,
        sum(map(eq, words, words[1:])) / n,
        len(set(words)) / n if words else 0.0,
        (size - len(raw) + sum(map(len, words))) / n,
        len(words) / max(1, len(lines)),
        1 - len(set(lines)) / len(lines) if lines else 0.0,
        len(raw),
    )
    bins = [f + int(np.searchsorted(b, s, "left")) for f, b, s in zip(_FIRST, BINS.values(), stats, strict=False)]
    distinct = set(raw.lower().split())
    hashed = np.fromiter(map(zlib.crc32, distinct), dtype=np.int64, count=len(distinct)) % buckets + _FIRST[-1]
    return np.concatenate([np.array(bins, dtype=np.int64), np.sort(hashed)]), np.concatenate([np.ones(len(bins), np.float32), np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed))), np.float32)])


@dataclass
class FactorisationMachine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray
    buckets: int
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.empty(len(rows))
        for a in range(0, len(rows), 256):
            part = rows[a : a + 256]
            idx, val = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
            starts = np.concatenate([[0], np.cumsum([len(r[0]) for r in part])])[:-1]
            vx = self.factors[idx] * val[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            out[a : a + 256] = self.bias + np.add.reduceat(self.linear[idx] * val, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.slope * self.margins([features(t, self.buckets) for t in texts]) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic calibration, by Newton's method with a little shrinkage.

    A step that doesn't lower the loss is halved until it does.
    """

    def loss(at: np.ndarray) -> float:
        z = at[0] * margin + at[1]
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + 0.05 * ((at[0] - 1) ** 2 + at[1] ** 2))

    at = np.array([1.0, 0.0])
    now = loss(at)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(at[0] * margin + at[1], -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p)
        grad = np.array([(g * margin).sum() + 0.1 * (at[0] - 1), g.sum() + 0.1 * at[1]])
        hess = np.array([[(h * margin**2).sum() + 0.1, (h * margin).sum()], [(h * margin).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        while (then := loss(at - step)) > now and np.abs(step).max() > 1e-6:
            step = step / 2
        if np.abs(step).max() <= 1e-6:
            break
        at, now = at - step, then
    return float(max(at[0], 0.05)), float(at[1])


def train(sample: list[tuple[bytes | None, int]], counts: dict[int, int], buckets: int = 1 << 14, rank: int = 6, epochs: int = 6, rate: float = 0.02, seed: int = 11) -> FactorisationMachine:
    rng = np.random.default_rng(seed)
    y = np.array([int(c) for _, c in sample])
    total = _FIRST[-1] + buckets
    fm = FactorisationMachine(0.0, np.zeros(total, np.float32), rng.normal(0, 0.05, (total, rank)).astype(np.float32), buckets)
    if len(set(y.tolist())) < 2:
        fm.constant = float(y[0]) if len(y) else 0.5
        return fm
    every = sum(counts.get(c, 0) for c in (0, 1))
    weight = np.array([counts.get(c, 1) / every * len(y) / max(1, (y == c).sum()) for c in (0, 1)])[y].astype(np.float32)
    rows = [features(t, buckets) for t, _ in sample]
    order = rng.permutation(len(rows))
    held, used = order[: len(rows) // 5], order[len(rows) // 5 :]
    m = [np.zeros_like(fm.linear), np.zeros_like(fm.factors)]
    v = [np.zeros_like(fm.linear), np.zeros_like(fm.factors)]
    step = 0
    for _ in range(epochs):
        used = rng.permutation(used)
        for a in range(0, len(used), 128):
            part = used[a : a + 128]
            idx, val = np.concatenate([rows[i][0] for i in part]), np.concatenate([rows[i][1] for i in part])
            sizes = np.array([len(rows[i][0]) for i in part])
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            vx = fm.factors[idx] * val[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            z = fm.bias + np.add.reduceat(fm.linear[idx] * val, starts) + 0.5 * (s**2 - np.add.reduceat(vx**2, starts, axis=0)).sum(axis=1)
            g = (weight[part] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) / len(part)).astype(np.float32)
            each = np.repeat(g, sizes)
            touched, inverse = np.unique(idx, return_inverse=True)
            g1 = np.bincount(inverse, weights=each * val, minlength=len(touched)).astype(np.float32) + 1e-5 * fm.linear[touched]
            raw = each[:, None] * val[:, None] * (np.repeat(s, sizes, axis=0) - vx)
            g2 = np.stack([np.bincount(inverse, weights=raw[:, f], minlength=len(touched)) for f in range(rank)], axis=1).astype(np.float32) + 1e-5 * fm.factors[touched]
            step += 1
            for p, grad, mm, vv in ((fm.linear, g1, m[0], v[0]), (fm.factors, g2, m[1], v[1])):
                mm[touched] = 0.9 * mm[touched] + 0.1 * grad
                vv[touched] = 0.99 * vv[touched] + 0.01 * grad**2
                p[touched] -= rate * (mm[touched] / (1 - 0.9**step)) / (np.sqrt(vv[touched] / (1 - 0.99**step)) + 1e-8)
            fm.bias -= rate * float(g.sum())
    if len(held):
        fm.slope, fm.shift = platt(fm.margins([rows[i] for i in held]), y[held], weight[held])
    return fm


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2500, **options) -> FactorisationMachine:
    """A model from at most `per_class` labelled texts of each class (label 0 or 1)."""
    sample, counts = class_sample(docs, labels, label, (0, 1), per_class, id_col, text_col)
    return train([(t.encode() if t is not None else None, y) for t, y in sample], counts, **options)


def score(model: FactorisationMachine, text: Column) -> Column:
    """The score (0 to 1) of a text column."""

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        return pa.array(model.scores(utf8(values)), pa.float64())

    return run(text)
