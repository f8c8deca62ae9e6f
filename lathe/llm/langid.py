"""Language identification: averaged hashed subword embeddings with a linear softmax.

A word (letters and bytes of non-ASCII characters, lower-cased) has the byte n-grams of 2 to 5 of
`<word>`, hashed into a fixed number of buckets. A text's vector is the mean of the embeddings of
all n-grams of all its words; a linear softmax gives the languages. Trained by stochastic gradient
descent in numpy on a bounded sample (`per_class` texts of each language); training, as scoring, reads
whole texts, of which the counts of distinct buckets are kept. As the model is linear after the mean, scoring keeps
the product of embeddings and softmax weights, one row of it for each bucket.

A temperature is fitted on a fifth of the sample that training leaves out, on its whole texts and on
excerpts of 3 words. The rejection limit is the score below which no more than `reject_share` of the
rightly named of them lie.

Defined results: null text, or one without a letter: `und`, score 0, rejected; one learned language:
that one; no labelled rows: every text is `und`. Extra columns pass through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.textops import class_sample, utf8

UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.lower().encode().translate(_FOLD).split()


def subwords(words: list[bytes], buckets: int, low: int = 2, high: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of each n-gram, number of n-grams of each word), grouped by word."""
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    flat = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words)), sizes)
    grams, owners = [], []
    h = np.zeros(len(flat), dtype=np.uint64)
    for n in range(1, high + 1):
        h = h[: len(flat) - n + 1] * np.uint64(1099511628211) + flat[n - 1 :] + np.uint64(n)
        if len(h) == 0:
            break
        if n >= low:
            inside = word[: len(h)] == word[n - 1 :]
            grams.append(h[inside])
            owners.append(word[: len(h)][inside])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    grams = grams[order]
    grams ^= grams >> np.uint64(31)
    return ((grams * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % buckets, np.bincount(owners, minlength=len(words))


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # buckets x languages: embeddings times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, texts: list[str | None], memo: _Words | None = None) -> np.ndarray:
        """A row for each text; all 0 for one without a letter."""
        memo = memo if memo is not None else _Words(self)
        parts = [memo.sums([words_of(t) if t else [] for t in texts[a : a + 256]]) for a in range(0, len(texts), 256)]
        sums, counts = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros((0, len(self.languages))), np.zeros(0))
        z = (sums / np.maximum(counts, 1)[:, None] + self.bias) / self.temperature
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[[not (t and _LETTER.search(t)) for t in texts]] = 0
        return p


class _Words:
    """Sums of a model's table rows over words; words met before are looked up."""

    def __init__(self, model: LanguageModel, size: int = 300_000):
        self.model, self.size = model, size
        self.clear()

    def clear(self):
        self.index: dict[bytes, int] = {}
        self.z = np.empty((1024, len(self.model.languages) + 1), dtype=np.float32)

    def sums(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((len(docs), self.z.shape[1]), dtype=np.float64)
        at, step = 0, 256
        while at < len(docs):
            part = docs[at : at + step]
            fresh = list(set().union(*part).difference(self.index))
            if len(self.index) + len(fresh) > self.size:
                self.clear()
                fresh = list(set().union(*part))
            if fresh:
                self._learn(fresh)
            flat = np.fromiter(map(self.index.__getitem__, chain.from_iterable(part)), dtype=np.int64, count=sum(map(len, part)))
            full = [k for k, d in enumerate(part) if d]
            if full:
                starts = np.concatenate([[0], np.cumsum([len(part[k]) for k in full])])[:-1]
                out[[at + k for k in full]] = np.add.reduceat(self.z[flat], starts, axis=0, dtype=np.float64)
            at += step
        return out[:, :-1], out[:, -1]

    def _learn(self, words: list[bytes]) -> None:
        n = len(self.index)
        if n + len(words) > len(self.z):
            self.z = np.concatenate([self.z, np.empty((max(len(self.z), n + len(words) - len(self.z)), self.z.shape[1]), np.float32)])
        for i in range(0, len(words), 8192):
            part = words[i : i + 8192]
            grams, sizes = subwords(part, len(self.model.table))
            starts = np.concatenate([[0], np.cumsum(sizes)])[:-1]
            self.z[n + i : n + i + len(part), :-1] = np.add.reduceat(self.model.table[grams], starts, axis=0)
            self.z[n + i : n + i + len(part), -1] = sizes
        self.index.update(zip(words, range(n, n + len(words)), strict=True))


def train(sample: list[tuple[str | None, str]], buckets: int = 1 << 16, dim: int = 16, epochs: int = 6, rate: float = 0.5, reject_share: float = 0.001, seed: int = 7) -> LanguageModel:
    """A model from (text, language) pairs, by stochastic gradient descent."""
    rng = np.random.default_rng(seed)
    sample = [(t, y) for t, y in sample if t and _LETTER.search(t) and y is not None]
    languages = sorted({y for _, y in sample})
    if not languages:
        return LanguageModel([UNKNOWN], np.zeros((1, 1), np.float32), np.zeros(1))
    number = {y: k for k, y in enumerate(languages)}
    order = rng.permutation(len(sample))
    held = [sample[i] for i in order[: len(sample) // 5]]
    rows = []
    for i in order[len(sample) // 5 :]:
        g, c = np.unique(subwords(words_of(sample[i][0]), buckets)[0], return_counts=True)
        if len(g):
            rows.append((g, (c / c.sum()).astype(np.float32)[:, None], number[sample[i][1]]))
    emb = rng.uniform(-1 / dim, 1 / dim, (buckets, dim)).astype(np.float32)
    out = np.zeros((dim, len(languages)), dtype=np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        lr = np.float32(rate * (1 - epoch / epochs))
        for k in rng.permutation(len(rows)):
            g, c, y = rows[k]
            v = (emb[g] * c).sum(axis=0)
            z = v @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = out @ p
            out -= lr * np.outer(v, p)
            bias -= lr * np.float32(0.1) * p
            emb[g] -= lr * len(g) * c * back * np.float32(0.05)
    model = LanguageModel(languages, emb @ out, bias)
    if held:
        held += [(" ".join(w[i : i + 3]), y) for t, y in held if len(w := t.split()) > 3 for i in (int(rng.integers(len(w) - 3)),)]
        held = [(t, y) for t, y in held if _LETTER.search(t)]
        known = np.array([number[y] for _, y in held])
        best = (np.inf, 1.0)
        for t in (0.01, 0.015, 0.025, 0.035, 0.05, 0.07, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 1.4, 2.0):
            model.temperature = t
            p = model.probabilities([x for x, _ in held])
            best = min(best, (-np.log(np.maximum(p[np.arange(len(held)), known], 1e-9)).mean(), t))
        model.temperature = best[1]
        p = model.probabilities([x for x, _ in held])
        right = p.max(axis=1)[p.argmax(axis=1) == known]
        if len(right):
            model.reject_below = float(min(0.5, np.quantile(right, reject_share)))
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_class: int = 1200, **options) -> LanguageModel:
    """A model from the non-null labels of `docs`, on at most `per_class` texts of each language."""
    sample, _ = class_sample(docs, docs.select(id_col, lang_col), lang_col, None, per_class, id_col, text_col)
    return train(sample, **options)


def predict(model: LanguageModel, text: Column) -> Column:
    """Struct of lang_pred, score and rejected for a text column."""
    memo = None

    @F.arrow_udf("lang_pred string, score double, rejected boolean")
    def score(values: pa.Array) -> pa.Array:
        nonlocal memo
        memo = memo or _Words(model)
        texts = [t.decode() if t is not None else None for t in utf8(values)]
        p = model.probabilities(texts, memo)
        best = p.argmax(axis=1)
        top = p[np.arange(len(texts)), best] if len(texts) else np.empty(0)
        known = (top > 0) & (np.array(model.languages, dtype=object)[best] != UNKNOWN) if len(texts) else np.empty(0, bool)
        names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)]
        top = np.where(known, top, 0.0)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(top, pa.float64()), pa.array(~known | (top < model.reject_below))], ["lang_pred", "score", "rejected"])

    return score(text)
