"""Toxicity by weak supervision.

Voters look at a text's words: a lexicon voter fires on one word, a pattern voter on any word that
begins with some letters. The seed lexicon below is joined by words and beginnings that a bounded
sample of labelled texts suggests. A generative label model of a latent class and the voters' votes
estimates how often each voter fires in either class and which voters depend on which: given the
class, votes are a forest, in which each voter depends on at most one other, the forest with the most
mutual information (so a voter that repeats another adds nothing). It is fitted by expectation
maximisation on the votes alone, started from their number; labels choose the voters, set the share of
the class and calibrate, but they neither vote nor start the model. Voters that never fire together, as
those of different languages, tell of different kinds of the class: each kind has a model of its own, in
which the silence of another kind's voters says nothing, and a text is of the class if it is of any kind
(one model of all would take the most frequent kind for the class). The posterior labels train a linear
classifier over word and beginning features, which is calibrated on a fifth of the sample and scores
whole texts: a text's margin is a sum over its distinct words.

Defined results: null and empty texts get the margin of no words; with one class or none among the
labels the score is that class's share (0 with none). Labels, languages, sources and ids are not
inputs of a score. Extra columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.llm.quality_fm import platt
from lathe.llm.textops import class_sample, utf8

#: Seed lexicon.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown", "dumb", "imbecile", "retard", "bastard", "bitch", "whore", "slut", "faggot", "asshole", "fuck", "shit", "cunt")
PREFIXES = (3, 4, 5, 6, 7)
_FOLD = bytes(b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(raw: bytes | None) -> set[bytes]:
    return set(raw.decode().lower().encode().translate(_FOLD).split()) if raw else set()


def keys_of(word: bytes) -> list[tuple[int, bytes]]:
    """The features of a word: (0, word) and (n, its first n bytes)."""
    return [(0, word), *((n, word[:n]) for n in PREFIXES if len(word) >= n)]


@dataclass
class LabelModel:
    """Voters' firing rates by class, the voter each depends on, and rates given that one's vote."""

    rates: np.ndarray  # 2 x voters
    parent: np.ndarray  # -1: none
    given: np.ndarray  # 2 (class) x 2 (the parent's vote) x voters
    correlation: np.ndarray  # voters x voters, within the classes
    prior: float

    @property
    def weights(self) -> np.ndarray:
        """How much of each voter's evidence is its own, for a look at the model."""
        return 1 / (1 + np.where(self.correlation < 0.2, 0, self.correlation).sum(axis=1))

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        on = fired > 0
        before = on[:, np.maximum(self.parent, 0)]
        z = np.full(len(fired), np.log(self.prior / (1 - self.prior)))
        rate = [np.where(self.parent < 0, alone, np.where(before, given[1], given[0])) for given, alone in zip(self.given, self.rates, strict=True)]
        z += np.where(on, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0]))).sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def forest(information: np.ndarray, least: float) -> np.ndarray:
    """The parent of each node (-1: none) in the spanning forest of most information; edges below `least` are left out."""
    n = len(information)
    parent, best = np.full(n, -1), np.full(n, -np.inf)
    left = np.ones(n, dtype=bool)
    for _ in range(n):
        i = int(np.where(left, best, -np.inf).argmax()) if np.isfinite(best[left]).any() else int(left.argmax())
        left[i] = False
        closer = left & (information[i] >= least) & (information[i] > best)
        best[closer], parent[closer] = information[i][closer], i
    return parent


def fit_label_model(fired: np.ndarray, start: np.ndarray, weight: np.ndarray, prior: float | None = None, rounds: int = 12) -> LabelModel:
    """Expectation maximisation from a first guess `start` of each row's probability; `prior` fixes the share of the class."""
    fired = (fired > 0).astype(np.float64)
    p, n = np.clip(start, 1e-4, 0.95), weight.sum()
    model = None
    for _ in range(rounds):
        rates, given, information, cov = [], [], 0.0, 0.0
        for q in (weight * (1 - p), weight * p):
            size = q.sum()
            both = fired.T @ (fired * q[:, None])
            once = np.diag(both)
            r = np.clip((once + 0.05) / (size + 1), 1e-4, 1 - 1e-4)
            # the four joint rates of each two voters, with a little independence mixed in
            joint = (both + np.outer(r, r)) / (size + 1)
            one, other = np.clip(r[:, None] - joint, 1e-9, None), np.clip(r[None, :] - joint, 1e-9, None)
            none = np.clip(1 - r[:, None] - r[None, :] + joint, 1e-9, None)
            joint = np.clip(joint, 1e-9, None)
            for cell, alone in ((joint, np.outer(r, r)), (one, np.outer(r, 1 - r)), (other, np.outer(1 - r, r)), (none, np.outer(1 - r, 1 - r))):
                information = information + size / n * cell * np.log(cell / alone)
            cov = cov + size / n * (joint - np.outer(r, r))
            rates.append(r)
            # [k, j]: the rate of j when k is silent, or fires; drawn to j's own rate
            fires = (both + 2 * r[None, :]) / (once[:, None] + 2)
            silent = (once[None, :] - both + 2 * r[None, :]) / (size - once[:, None] + 2)
            given.append(np.clip([silent, fires], 1e-4, 1 - 1e-4))
        rates = np.array(rates)
        rates[1] = np.maximum(rates[1], rates[0])  # a voter votes for the class
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        correlation = np.clip(cov / scale[:, None] / scale[None, :], 0, 1)
        np.fill_diagonal(correlation, 0)
        np.fill_diagonal(information, 0)
        parent = forest(information, 4 / n)
        at = np.arange(len(parent))
        chosen = np.array([[g[s][np.maximum(parent, 0), at] for s in (0, 1)] for g in given])
        share = prior if prior is not None else (weight * p).sum() / n
        model = LabelModel(rates, parent, chosen, correlation, float(np.clip(share, 1e-3, 1 - 1e-3)))
        p = model.posterior(fired)
    return model


def first_guess(fired: np.ndarray, weight: np.ndarray, share: float) -> np.ndarray:
    """0.9 for the rows with the most votes, about `share` of all by weight, and 0.1 for the rest."""
    votes = (fired > 0).sum(axis=1)
    order = np.argsort(-votes, kind="stable")
    limit = votes[order][min(len(votes) - 1, int(np.searchsorted(np.cumsum(weight[order]), share * weight.sum())))]
    return np.where(votes >= max(1, limit), 0.9, 0.1)


@dataclass
class KindsModel:
    """A label model for each kind of the class, with the columns of its voters."""

    kinds: list[tuple[np.ndarray, LabelModel]]

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        none = np.ones(len(fired))
        for columns, model in self.kinds:
            none *= 1 - model.posterior(fired[:, columns])
        return 1 - none


def kinds_of(fired: np.ndarray) -> list[np.ndarray]:
    """Groups of voters; two are in one group if they, or others between them, fire together at least half
    as often as by chance, among the rows that any voter fires on."""
    on = (fired > 0).astype(np.float64)
    on = on[on.any(axis=1)]
    size, both = on.sum(axis=0), on.T @ on
    linked = (both > 0) & (2 * both * len(on) >= np.outer(size, size))
    group = np.full(on.shape[1], -1)
    for i in range(len(group)):
        if group[i] < 0:
            group[i], left = i, [i]
            while left:
                new = np.flatnonzero(linked[left.pop()] & (group < 0))
                group[new] = i
                left += new.tolist()
    return [np.flatnonzero(group == g) for g in np.unique(group)]


def fit_kinds(fired: np.ndarray, start: np.ndarray, weight: np.ndarray, prior: float) -> KindsModel:
    """A label model for each kind; a kind's share of the prior is that of the first guesses it has votes for."""
    guessed, models = start > 0.5, []
    every = weight[guessed].sum()
    for columns in kinds_of(fired):
        mine = guessed & (fired[:, columns] > 0).any(axis=1)
        if mine.any():
            share = prior * weight[mine].sum() / every
            models.append((columns, fit_label_model(fired[:, columns], np.where(mine, 0.9, 0.1 * share), weight, share)))
    return KindsModel(models or [(np.arange(fired.shape[1]), fit_label_model(fired, start, weight, prior))])


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, rounds: int = 12) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton's method; the last column of x is constant 1."""
    b = np.zeros(x.shape[1])
    shrink = np.full(x.shape[1], penalty)
    shrink[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weight * (p - y)) + shrink * b
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(shrink)
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-5:
            break
    return b


@dataclass
class ToxicityModel:
    weights: dict[tuple[int, bytes], float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0
    constant: float | None = None
    voters: list[tuple[int, bytes]] = field(default_factory=list)
    label_model: KindsModel | None = None
    #: Of the sample: posterior labels, which train the classifier, and given ones.
    posterior: np.ndarray | None = None
    given: np.ndarray | None = None

    def memo(self, size: int = 300_000):
        weights = self.weights

        class Memo(dict):
            def __missing__(self, word):
                if len(self) >= size:
                    self.clear()
                self[word] = v = sum(weights.get(k, 0.0) for k in keys_of(word))
                return v

        return Memo()

    def scores(self, texts: list[bytes | None], memo=None) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        get = (memo if memo is not None else self.memo()).__getitem__
        z = self.slope * (np.array([sum(map(get, words_of(t))) for t in texts]) + self.bias) + self.shift
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def train(sample: list[tuple[bytes | None, int]], counts: dict[int, int], max_voters: int = 200, max_features: int = 1500, penalty: float = 0.1, weak: bool = True, seed: int = 3) -> ToxicityModel:
    """A model of (text, label) rows; `weak=False` trains the classifier on the labels instead of the posterior, for comparison."""
    y = np.array([int(c) for _, c in sample])
    if len(set(y.tolist())) < 2:
        return ToxicityModel(constant=float(y[0]) if len(y) else 0.0)
    every = sum(counts.get(c, 0) for c in (0, 1))
    weight = np.array([counts.get(c, 1) / every * len(y) / max(1, (y == c).sum()) for c in (0, 1)])[y]
    held = np.random.default_rng(seed).random(len(y)) < 0.2
    number: dict[bytes, int] = {}  # features as numbers; a feature is its kind's byte and its letters
    docs = []
    for t, _ in sample:
        keys = np.fromiter((number.setdefault(bytes((n,)) + k, len(number)) for w in words_of(t) for n, k in keys_of(w)), dtype=np.int32)
        docs.append(tuple(x.astype(np.int32) for x in np.unique(keys, return_counts=True)))
    names = list(number)
    del number, sample

    def frequencies(p: np.ndarray, purity: float = 0.0) -> list[tuple[float, int]]:
        """Features that part the classes by more than chance, the strongest first; of those texts that
        have one, weighted, `purity` at least are of the class."""
        count = lambda rows: np.bincount(np.concatenate([docs[i][0] for i in rows] or [np.empty(0, np.int32)]), minlength=len(names)).astype(float)
        used = np.flatnonzero(~held)
        seen, among = count(used), count([i for i in used if p[i] > 0.5])
        n, share = len(used), (p[used] > 0.5).mean()
        z = (among - seen * share) / np.sqrt(seen * share * (1 - share) * (1 - seen / n) + 0.5)
        on, off = (weight[used][p[used] > 0.5].mean() if share else 0.0), (weight[used][p[used] <= 0.5].mean() if share < 1 else 0.0)
        some = np.flatnonzero((seen >= 4) & (np.abs(z) > 4.5) & (among * on >= purity * (among * on + (seen - among) * off)))
        return sorted(((z[i], i) for i in some.tolist()), key=lambda x: (-abs(x[0]), names[x[1]]))

    def matrix(keys: list[int]) -> np.ndarray:
        column = np.full(len(names), -1, dtype=np.int32)
        column[keys] = np.arange(len(keys))
        x = np.zeros((len(docs), len(keys)), dtype=np.float32)
        for r, (ids, times) in enumerate(docs):
            at = column[ids]
            x[r, at[at >= 0]] = times[at >= 0]
        return x

    def apart(keys: list[int], most: int) -> list[int]:
        """Those that fire on other texts than the ones before them."""
        on = (matrix(keys)[~held] > 0).astype(np.float32)
        both, size = on.T @ on, on.sum(axis=0)
        alike, taken = both >= 0.8 * (size[:, None] + size[None, :] - both), []
        for i in range(len(keys)):
            if len(taken) < most and not alike[i, taken].any():
                taken.append(i)
        return [keys[i] for i in taken]

    known = {n: i for i, n in enumerate(names) if n[0] == 0}
    seeds = [known[k] for s in SEEDS if (k := b"\0" + s.encode()) in known]
    del known
    voters = list(dict.fromkeys([*apart([k for z, k in frequencies(y.astype(float), 0.7) if z > 0][:max_features], max_voters), *seeds]))
    fired = (matrix(voters) > 0).astype(np.float64)
    share = float((weight * y)[~held].sum() / weight[~held].sum())
    label_model = fit_kinds(fired[~held], first_guess(fired[~held], weight[~held], share), weight[~held], share)
    posterior = label_model.posterior(fired) if weak else y.astype(float)

    features = apart([k for _, k in frequencies(posterior)[:max_features]], max_voters)
    x = np.column_stack([matrix(features), np.ones(len(docs))]).astype(np.float64)
    beta = _logistic(x[~held], posterior[~held], weight[~held], penalty)
    slope, shift = platt(x[held] @ beta, y[held], weight[held]) if len(set(y[held].tolist())) == 2 else (1.0, 0.0)
    spelt = lambda keys: [(names[i][0], names[i][1:]) for i in keys]
    return ToxicityModel(dict(zip(spelt(features), beta[:-1].tolist(), strict=True)), float(beta[-1]), slope, shift, None, spelt(voters), label_model, posterior, y)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", per_class: int = 2000, **options) -> ToxicityModel:
    """A model from at most `per_class` labelled texts of each class (label 0 or 1)."""
    sample, counts = class_sample(docs, labels, label, (0, 1), per_class, id_col, text_col)
    return train([(t.encode() if t is not None else None, y) for t, y in sample], counts, **options)


def score(model: ToxicityModel, text: Column) -> Column:
    """The score (0 to 1) of a text column."""
    memo = None

    @F.arrow_udf("double")
    def run(values: pa.Array) -> pa.Array:
        nonlocal memo
        memo = memo if memo is not None else model.memo()
        return pa.array(model.scores(utf8(values), memo), pa.float64())

    return run(text)
