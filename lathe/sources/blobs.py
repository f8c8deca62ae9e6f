"""Model blobs inside bundles: what they hold, read into arrays, with vectorised scorers.

Formats (all little-endian): neighbours (header, rows, labels), clauses (header, thresholds, packed
automaton states, labels), factorisation (named score and loss, sizes, weights interleaved with
gradient caches), additive (JSON of cuts, terms and scores) and forests (JSON of node arrays).
"""

from __future__ import annotations

import json
import struct
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from lathe.errors import BundleError
from lathe.functions import expressions as X

# Fixed values of the formats.
NEIGHBOURS_HEADER, NEIGHBOURS_MAGIC = struct.Struct("<4sIII"), b"NF01"
CLAUSES_HEADER, CLAUSES_MAGIC = struct.Struct("<4s7IdBBH4xdd"), b"TM01"
LANES = 4
ADDITIVE_FORMAT = "ebm-json-v1"


def _need(raw: bytes, at: int, n: int, what: str) -> None:
    if at + n > len(raw):
        raise BundleError(f"the blob ends within its {what}")


def _array(raw: bytes, at: int, kind: str, n: int, what: str) -> tuple[np.ndarray, int]:
    size = np.dtype(kind).itemsize * n
    _need(raw, at, size, what)
    return np.frombuffer(raw, kind, n, at).copy(), at + size


@dataclass
class NeighboursBlob:
    x: np.ndarray
    y: np.ndarray
    regression: bool

    def encode(self) -> bytes:
        head = NEIGHBOURS_HEADER.pack(NEIGHBOURS_MAGIC, *self.x.shape, int(self.regression))
        return head + np.ascontiguousarray(self.x, "<f8").tobytes() + np.ascontiguousarray(self.y, "<f8" if self.regression else "<i4").tobytes()

    @classmethod
    def decode(cls, raw: bytes) -> NeighboursBlob:
        raw = bytes(raw)
        _need(raw, 0, NEIGHBOURS_HEADER.size, "header")
        magic, n, width, task = NEIGHBOURS_HEADER.unpack_from(raw)
        if magic != NEIGHBOURS_MAGIC:
            raise BundleError(f"bad magic {magic!r}")
        x, at = _array(raw, NEIGHBOURS_HEADER.size, "<f8", n * width, "rows")
        y, _ = _array(raw, at, "<f8" if task else "<i4", n, "labels")
        return cls(x.reshape(n, width), y, bool(task))

    def frame(self, spark):
        """The training rows as (train_id, vector, label)."""
        kind = "double" if self.regression else "int"
        return spark.createDataFrame([(i, v.tolist(), y.item()) for i, (v, y) in enumerate(zip(self.x, self.y, strict=True))], f"train_id long, vector array<double>, label {kind}")


@dataclass
class ClausesBlob:
    n_clauses: int
    state_bits: int
    threshold: int
    s: float
    regression: bool
    boost: bool
    per_feature: int
    y_range: tuple[float, float]
    cuts: list[np.ndarray]
    state: np.ndarray  # classes x clauses x words x bits, unsigned 32-bit
    labels: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))

    @property
    def words(self) -> int:
        return -(-2 * sum(map(len, self.cuts)) // 32)

    def encode(self) -> bytes:
        n_binary = sum(map(len, self.cuts))
        head = CLAUSES_HEADER.pack(CLAUSES_MAGIC, 1, self.n_clauses, len(self.cuts), self.state.shape[0], n_binary, self.state_bits, self.threshold, self.s, int(self.regression), int(self.boost), self.per_feature, *self.y_range)
        parts = [head, np.array([len(c) for c in self.cuts], "<i4").tobytes(), *(np.asarray(c, "<f8").tobytes() for c in self.cuts), np.ascontiguousarray(self.state, "<u4").tobytes()]
        return b"".join(parts + ([] if self.regression else [np.asarray(self.labels, "<i4").tobytes()]))

    @classmethod
    def decode(cls, raw: bytes) -> ClausesBlob:
        raw = bytes(raw)
        _need(raw, 0, CLAUSES_HEADER.size, "header")
        magic, version, clauses, features, classes, binary, bits, top, s, task, boost, per, low, high = CLAUSES_HEADER.unpack_from(raw)
        if magic != CLAUSES_MAGIC or version != 1:
            raise BundleError(f"bad magic {magic!r} or version {version}")
        counts, at = _array(raw, CLAUSES_HEADER.size, "<i4", features, "threshold counts")
        if counts.sum() != binary:
            raise BundleError("threshold counts don't add up")
        cuts = []
        for n in counts:
            c, at = _array(raw, at, "<f8", int(n), "thresholds")
            cuts.append(c)
        words = -(-2 * binary // 32)
        outputs = max(1, classes)
        state, at = _array(raw, at, "<u4", outputs * clauses * words * bits, "states")
        labels = _array(raw, at, "<i4", classes, "labels")[0] if not task else np.empty(0, np.int32)
        return cls(clauses, bits, top, s, bool(task), bool(boost), per, (low, high), cuts, state.reshape(outputs, clauses, words, bits), labels)

    def included(self) -> np.ndarray:
        """(classes, clauses, literals): the top bit of each automaton, without those past the last literal."""
        n = 2 * sum(map(len, self.cuts))
        top = np.ascontiguousarray(self.state[..., -1])
        return np.unpackbits(top.view(np.uint8).reshape(*top.shape, 4), axis=-1, bitorder="little").reshape(*top.shape[:2], -1)[..., :n].astype(bool)

    def votes(self, x: np.ndarray) -> np.ndarray:
        on = np.concatenate([x[:, [j]] > c[None] for j, c in enumerate(self.cuts)], axis=1)
        off = ~np.concatenate([on, ~on], axis=1)
        sign = np.where(np.arange(self.n_clauses) < self.n_clauses // 2, 1, -1)
        inc = self.included()
        fired = (np.einsum("nl,ckl->nck", off.astype(np.int32), inc.astype(np.int32)) == 0) & inc.any(axis=2)[None]
        return (fired * sign).sum(axis=2)

    def predict(self, x: np.ndarray) -> np.ndarray:
        v = self.votes(np.asarray(x, float))
        if not self.regression:
            return self.labels[v.argmax(axis=1)]
        low, high = self.y_range
        return low + np.clip(v[:, 0], 0, self.threshold) / self.threshold * (high - low)


@dataclass
class FactorisationBlob:
    score: str  # linear, fm or ffm
    loss: str
    w: np.ndarray
    b: float
    v: np.ndarray | None = None  # (features, k) or (features, fields, k)
    aux: int = 2

    @classmethod
    def decode(cls, raw: bytes) -> FactorisationBlob:
        raw, at, names = bytes(raw), 0, []
        for _ in range(2):
            _need(raw, at, 4, "names")
            (n,) = struct.unpack_from("<I", raw, at)
            _need(raw, at + 4, n, "names")
            names.append(raw[at + 4 : at + 4 + n].decode("ascii"))
            at += 4 + n
        linear = names[0] == "linear"
        sizes, at = _array(raw, at, "<u4", 5 if linear else 6, "sizes")
        features, fields, k, aux, n_w = (int(x) for x in sizes[:5])
        w, at = _array(raw, at, "<f4", n_w, "weights")
        b, at = _array(raw, at, "<f4", aux, "bias")
        v = None
        if not linear and sizes[5]:
            flat, at = _array(raw, at, "<f4", int(sizes[5]), "factors")
            lanes = -(-k // LANES) * LANES
            shape = (features, lanes * aux) if names[0] == "fm" else (features, fields, lanes * aux)
            v = flat.reshape(shape)[..., :k].astype(float)
        return cls(names[0], names[1], w[::aux][:features].astype(float), float(b[0]), v, aux)

    def encode(self) -> bytes:
        """Gradient caches are written as ones."""
        features = len(self.w)
        fields, k = (0, 0) if self.v is None else (0 if self.v.ndim == 2 else self.v.shape[1], self.v.shape[-1])
        w = np.ones((features, self.aux), "<f4")
        w[:, 0] = self.w
        b = np.ones(self.aux, "<f4")
        b[0] = self.b
        parts = [struct.pack("<I", len(s)) + s.encode("ascii") for s in (self.score, self.loss)]
        sizes, tail = [features, fields, k, self.aux, w.size], b""
        if self.v is not None:
            v = np.ones((*self.v.shape[:-1], -(-k // LANES) * LANES * self.aux), "<f4")
            v[..., :k] = self.v
            sizes.append(v.size)
            tail = v.tobytes()
        elif self.score != "linear":
            sizes.append(0)
        return b"".join([*parts, np.array(sizes, "<u4").tobytes(), w.tobytes(), b.tobytes(), tail])

    def margin(self, xs: list[Column], fields: list[int] | None = None, normalise: bool = True) -> Column:
        """The score as one expression. The linear score isn't normalised."""
        if self.score == "linear" or self.v is None:
            return X.linear(xs, self.w.tolist(), self.b)
        if self.score == "fm":
            return X.factorisation(xs, self.w.tolist(), self.b, self.v.tolist(), normalise)
        return X.field_aware(xs, fields or list(range(len(xs))), self.w.tolist(), self.b, self.v.tolist(), normalise)


@dataclass
class AdditiveBlob:
    task: str
    intercept: list[float]
    cuts: list[list[float]]
    terms: list[dict]

    @classmethod
    def decode(cls, raw: bytes) -> AdditiveBlob:
        spec = json.loads(bytes(raw).decode())
        if spec.get("format") != ADDITIVE_FORMAT:
            raise BundleError(f"unknown format {spec.get('format')!r}")
        for t in spec["terms"]:
            if len(t["scores"]) != int(np.prod(t["binCounts"])) * spec["nScores"]:
                raise BundleError("a term's scores don't fit its bins")
        return cls(spec["task"], spec["intercept"], [f.get("cuts", []) for f in spec["features"]], spec["terms"])

    def encode(self) -> bytes:
        spec = {"format": ADDITIVE_FORMAT, "task": self.task, "nFeatures": len(self.cuts), "nTerms": len(self.terms), "nScores": len(self.intercept), "intercept": self.intercept, "features": [{"type": "continuous", "cuts": c} for c in self.cuts], "terms": self.terms}
        return json.dumps(spec).encode()

    def contributions(self, xs: list[Column]) -> list[list[Column]]:
        """For each term, a column for each output: bins by cuts at or below, missing ones last."""
        out, width = [], len(self.intercept)
        for t in self.terms:
            at = F.lit(0)
            for f, n in zip(t["features"], t["binCounts"], strict=True):
                at = at * n + F.least(X.bin_index(xs[f], self.cuts[f]), F.lit(min(len(self.cuts[f]), n - 1)))
            out.append([X.pick(t["scores"][s::width], at) for s in range(width)])
        return out

    def margins(self, xs: list[Column]) -> list[Column]:
        parts = self.contributions(xs)
        return [F.lit(float(b)) + X.total([p[s] for p in parts]) for s, b in enumerate(self.intercept)]


@dataclass
class ForestBlob:
    """Samples of forests: the mean over samples of the sum of trees, scaled back."""

    spec: dict

    @classmethod
    def decode(cls, raw: bytes) -> ForestBlob:
        spec = json.loads(bytes(raw).decode())
        if "forest_container" not in spec:
            raise BundleError("the blob holds no forests")
        return cls(spec)

    def encode(self) -> bytes:
        return json.dumps(self.spec).encode()

    def _trees(self):
        box = self.spec["forest_container"]
        for i in range(box["num_samples"]):
            forest = box[f"forest_{i}"]
            for t in range(forest["num_trees"]):
                yield forest[f"tree_{t}"]

    def margin(self, x: np.ndarray) -> np.ndarray:
        x, total = np.asarray(x, float), np.zeros(len(x))
        for tree in self._trees():
            kind, f, cut, left, right, leaf = (np.asarray(tree[k]) for k in ("node_type", "split_index", "threshold", "left", "right", "leaf_value"))
            at = np.zeros(len(x), dtype=int)
            while (inner := np.flatnonzero(kind[at] == 1)).size:
                low = x[inner, f[at[inner]]] <= cut[at[inner]]
                at[inner] = np.where(low, left[at[inner]], right[at[inner]])
            total += leaf[at]
        n = max(1, self.spec["forest_container"]["num_samples"])
        return total / n * self.spec.get("y_std", 1.0) + self.spec.get("y_bar", 0.0)

    def frame(self, spark):
        """(tree, node, feature, threshold, left, right, value, leaf) of all nodes."""
        rows = [(i, n, int(t["split_index"][n]), float(t["threshold"][n]), int(t["left"][n]), int(t["right"][n]), float(t["leaf_value"][n]), t["node_type"][n] != 1) for i, t in enumerate(self._trees()) for n in range(len(t["node_type"]))]
        return spark.createDataFrame(rows, "tree int, node int, feature int, threshold double, left int, right int, value double, leaf boolean")
