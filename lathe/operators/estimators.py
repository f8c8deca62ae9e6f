"""Local estimators in numpy, with one contract: fit, predict, predict_proba, score, save, load.

They run on the driver or inside a task, on data that fits there; search and ensembles fan them out
over candidates and folds. `lathe.operators.distributed` has their counterparts for data that doesn't.
Labels are any sortable values; probabilities follow the sorted classes.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np

from lathe.errors import DisposedError, NotFittedError, ValidationError
from lathe.sources.bundle import decode_json, encode_bundle, encode_json
from lathe.sources.registry import register


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Estimator:
    """Base of all local estimators. `task` is classification, regression or None (told from y)."""

    family = ""
    defaults: dict = {}

    def __init__(self, task: str | None = None, **params):
        self._check(params)
        self.task, self.params = task, dict(params)
        self.state: dict | None = None
        self._disposed = False

    def get_params(self) -> dict:
        return dict(self.params)

    def set_params(self, params: dict) -> Estimator:
        """Replaces the parameters; the model is to be fitted again."""
        self._check(params)
        self.params, self.state = dict(params), None
        return self

    def _check(self, params: dict) -> None:
        if unknown := sorted(set(params) - set(self.defaults)):
            raise ValidationError(f"{self.family} has no parameters {', '.join(unknown)}")

    def param(self, name: str):
        return self.params.get(name, self.defaults[name])

    @property
    def is_fitted(self) -> bool:
        return self.state is not None and not self._disposed

    @property
    def classes(self) -> list:
        return list(self._ready()["classes"])

    def _ready(self) -> dict:
        if self._disposed:
            raise DisposedError
        if self.state is None:
            raise NotFittedError
        return self.state

    def dispose(self) -> None:
        self.state, self._disposed = None, True

    @staticmethod
    def tell_task(y) -> str:
        y = np.asarray(y)
        if y.dtype.kind in "iubOU":
            return "classification"
        return "classification" if (y == np.floor(y)).all() and len(np.unique(y)) <= 20 else "regression"

    def fit(self, x, y) -> Estimator:
        if self._disposed:
            raise DisposedError
        x, y = np.asarray(x, dtype=np.float64), np.asarray(y)
        if x.ndim != 2 or not len(x) or len(x) != len(y):
            raise ValidationError(f"bad shapes {x.shape} and {y.shape}")
        task = self.task or self.tell_task(y)
        state = {"task": task, "width": x.shape[1], "classes": []}
        if task == "classification":
            classes, codes = np.unique(y, return_inverse=True)
            state["classes"] = classes.tolist()
            state |= self._fit(x, codes, len(classes)) if len(classes) > 1 else {"only": True}
        else:
            state |= self._fit(x, y.astype(np.float64), 0)
        self.state = state
        return self

    def _scores(self, x) -> np.ndarray:
        s = self._ready()
        x = np.asarray(x, dtype=np.float64)
        if x.ndim != 2 or x.shape[1] != s["width"]:
            raise ValidationError(f"the model takes {s['width']} features; got {x.shape}")
        return self._predict(x, s)

    def predict_proba(self, x) -> np.ndarray:
        s = self._ready()
        if s["task"] != "classification":
            raise ValidationError("a regression model has no probabilities")
        if s.get("only"):
            return np.ones((len(x), 1))
        return self._scores(x)

    def predict(self, x) -> np.ndarray:
        s = self._ready()
        if s["task"] == "classification":
            return np.asarray(s["classes"])[self.predict_proba(x).argmax(axis=1)]
        return self._scores(x)

    def score(self, x, y) -> float:
        """Accuracy, or R squared (0 for a constant y)."""
        y, p = np.asarray(y), self.predict(x)
        if self._ready()["task"] == "classification":
            return float((y == p).mean())
        total = ((y - y.mean()) ** 2).sum()
        return float(1 - ((y - p) ** 2).sum() / total) if total else 0.0

    def save(self) -> bytes:
        s = self._ready()
        arrays, plain = {}, {}
        _split(s, "", arrays, plain)
        buffer = io.BytesIO()
        np.savez(buffer, **arrays)
        manifest = {"typeId": f"lathe.{self.family}@1", "params": self.params, "metadata": {"task": s["task"], "nFeatures": s["width"]}}
        return encode_bundle(manifest, [{"id": "state", "data": encode_json(plain), "mediaType": "application/json"}, {"id": "weights", "data": buffer.getvalue(), "mediaType": "application/octet-stream"}])

    @classmethod
    def restore(cls, manifest, _toc, blobs) -> Estimator:
        made = cls(manifest["metadata"]["task"], **manifest["params"])
        with np.load(io.BytesIO(blobs["weights"])) as arrays:
            made.state = _join(decode_json(blobs["state"]), arrays)
        return made


def _split(value, path: str, arrays: dict, plain: dict) -> None:
    for k, v in value.items():
        at = f"{path}{k}"
        if isinstance(v, np.ndarray):
            arrays[at] = v
            plain[k] = {"$array": at}
        elif isinstance(v, list) and v and isinstance(v[0], np.ndarray):
            for i, a in enumerate(v):
                arrays[f"{at}.{i}"] = a
            plain[k] = {"$arrays": at, "n": len(v)}
        else:
            plain[k] = v.item() if isinstance(v, np.generic) else v


def _join(plain: dict, arrays) -> dict:
    out = {}
    for k, v in plain.items():
        if isinstance(v, dict) and "$array" in v:
            out[k] = arrays[v["$array"]]
        elif isinstance(v, dict) and "$arrays" in v:
            out[k] = [arrays[f"{v['$arrays']}.{i}"] for i in range(v["n"])]
        else:
            out[k] = v
    return out


class Baseline(Estimator):
    """The majority class (shares as probabilities), or the mean."""

    family = "baseline"

    def _fit(self, x, y, k):
        return {"prior": np.bincount(y, minlength=k) / len(y)} if k else {"mean": float(y.mean())}

    def _predict(self, x, s):
        return np.tile(s["prior"], (len(x), 1)) if s["classes"] else np.full(len(x), s["mean"])


class Linear(Estimator):
    """Linear models: 0, 7 ridge logistic; 6 lasso logistic; 1, 2 squared hinge; 3 hinge; 5 lasso squared hinge; 11-13 epsilon-insensitive regression. Several classes are one against the rest."""

    family = "linear"
    defaults = {"solver": 0, "C": 1.0, "eps": 1e-4, "bias": 1.0, "p": 0.1}

    def _fit(self, x, y, k):
        b = self.param("bias")
        x1 = np.column_stack([x, np.full(len(x), b)]) if b >= 0 else x
        if not k:
            return {"w": self._regress(x1, y)[None]}
        sides = [1] if k == 2 else range(k)
        return {"w": np.stack([self._binary(x1, np.where(y == c, 1.0, -1.0)) for c in sides])}

    def _binary(self, x, t):
        solver, c = self.param("solver"), self.param("C")
        lasso = solver in (5, 6)
        w, step = np.zeros(x.shape[1]), None
        if not lasso and solver in (0, 7):
            for _ in range(50):
                p = _sigmoid(t * (x @ w))
                g = w - c * x.T @ (t * (1 - p))
                if np.abs(g).max() < self.param("eps") * len(x):
                    break
                h = np.eye(len(w)) + c * (x * (p * (1 - p))[:, None]).T @ x
                step = np.linalg.solve(h, g)
                w = w - step
            return w
        curve = 0.25 if solver == 6 else 2.0
        rate = 1 / (c * curve * np.linalg.norm(x, 2) ** 2 + (0 if lasso else 1) + 1e-9)
        momentum, old = w.copy(), w.copy()
        for i in range(1, 1001):
            m = t * (x @ momentum)
            if solver == 6:
                g = -c * x.T @ (t * _sigmoid(-m))
            elif solver == 3:
                g = -c * x.T @ (t * np.clip((1 - m) * 4, 0, 1))  # hinge with a rounded corner
            else:
                g = -2 * c * x.T @ (t * np.maximum(1 - m, 0))
            w = momentum - rate * (g + (0 if lasso else momentum))
            if lasso:
                w = np.sign(w) * np.maximum(np.abs(w) - rate, 0)
            if np.abs(w - old).max() < 1e-8:
                break
            momentum, old = w + (i - 1) / (i + 2) * (w - old), w
        return w

    def _regress(self, x, y):
        c, p, squared = self.param("C"), self.param("p"), self.param("solver") != 13
        rate = 1 / (2 * c * np.linalg.norm(x, 2) ** 2 + 1)
        w = np.linalg.lstsq(x.T @ x * c * 2 + np.eye(x.shape[1]), 2 * c * x.T @ y, rcond=None)[0]
        momentum, old = w.copy(), w.copy()
        for i in range(1, 1001):
            r = x @ momentum - y
            over = np.sign(r) * np.maximum(np.abs(r) - p, 0)
            g = 2 * c * x.T @ over if squared else c * x.T @ np.clip(over * 10, -1, 1)
            w = momentum - rate * (g + momentum)
            if np.abs(w - old).max() < 1e-9:
                break
            momentum, old = w + (i - 1) / (i + 2) * (w - old), w
        return w

    def _predict(self, x, s):
        b = self.param("bias")
        z = (np.column_stack([x, np.full(len(x), b)]) if b >= 0 else x) @ s["w"].T
        if not s["classes"]:
            return z[:, 0]
        if len(s["classes"]) == 2:
            p = _sigmoid(z[:, 0])
            return np.column_stack([1 - p, p])
        p = _sigmoid(z)
        return p / p.sum(axis=1, keepdims=True)


#: Values that a whole kernel matrix, and a factor of one, hold at most; what a factor may change in a row's margin.
GRAM_CELLS, FACTOR_CELLS, MARGIN = 1 << 22, 100_000_000, 1e-3
#: Values of a block of distances or kernels; rows that a pivot block is chosen from.
BLOCK_CELLS, PIVOT_BLOCK = 1 << 21, 192


class Factor:
    """F with F F' = K but for `tol` in each value, by a Cholesky factorisation of a positive semidefinite
    K with pivots in blocks; `columns` gives K's columns of some rows, `inner` K among some rows.
    F lies in parts of some columns. `whole` is false if it takes more than `cells` values."""

    def __init__(self, columns, inner, diag: np.ndarray, tol: float, cells: int):
        self.left, self.parts, self.pivots = diag.astype(float), [], np.empty(0, np.int64)
        left, n, self.whole = self.left, len(diag), True
        tol = max(tol, 64 * np.finfo(float).eps * left.max(initial=0))  # values are known no better
        while (top := left.max(initial=0)) > tol:
            some = np.argpartition(-left, min(n, PIVOT_BLOCK) - 1)[:PIVOT_BLOCK]
            some = some[left[some] > tol]
            known = self.rows(some)
            rest = inner(some) - known @ known.T
            order, low = self._pivots(rest, max(tol, top / 4))
            chosen = some[order]
            if (self.width + len(chosen)) * n > cells:
                self.whole = False
                return
            new = columns(chosen)
            for part in self.parts:
                new -= part @ part[chosen].T
            self.parts.append(new @ np.linalg.inv(low).T)
            left -= np.einsum("ij,ij->i", self.parts[-1], self.parts[-1])
            left[chosen] = 0
            np.maximum(left, 0, out=left)
            self.pivots = np.concatenate([self.pivots, chosen])

    @staticmethod
    def _pivots(rest, least):
        """The order of pivots within a block, while what is left is over `least`, and their triangle."""
        left, out, low = np.diag(rest).copy(), [], np.zeros((len(rest), len(rest)))
        while not out or len(out) < len(rest) and left.max() > least:
            p, m = int(left.argmax()), len(out)
            low[:, m] = (rest[:, p] - low[:, :m] @ low[p, :m]) / math.sqrt(left[p])
            left -= low[:, m] ** 2
            left[p] = 0
            out.append(p)
        return np.array(out), np.tril(low[out, : len(out)])

    @property
    def width(self) -> int:
        return len(self.pivots)

    def rows(self, i: np.ndarray) -> np.ndarray:
        return np.concatenate([part[i] for part in self.parts], axis=1) if self.parts else np.zeros((len(i), 0))

    def times(self, w: np.ndarray) -> np.ndarray:
        """F w."""
        out, at = np.zeros(len(self.left)), 0
        for part in self.parts:
            out += part @ w[at : at + part.shape[1]]
            at += part.shape[1]
        return out

    def back(self, a: np.ndarray) -> np.ndarray:
        """F' a."""
        return np.concatenate([part.T @ a for part in self.parts]) if self.parts else np.zeros(0)

    def diagonal(self) -> np.ndarray:
        return sum((np.einsum("ij,ij->i", part, part) for part in self.parts), np.zeros(len(self.left)))


class Gram:
    """A kernel matrix plus 1: whole for few rows, as a factor for many, else a column at a time.

    What a factor leaves out is positive semidefinite with at most `tol` on its diagonal, hence in each
    value; with dual values that add up to `total` at most it moves no margin by more than MARGIN.
    """

    def __init__(self, machine: KernelMachine, x: np.ndarray, total: float, many: bool):
        self.machine, self.x, self.whole, self.factor = machine, x, None, None
        if many and machine.semidefinite:
            found = Factor(self.columns, lambda i: machine.kernel(x[i], x[i]) + 1, self.diagonal(), MARGIN / total, FACTOR_CELLS)
            self.factor = found if found.whole else None
        if self.factor is None and len(x) ** 2 <= GRAM_CELLS:
            self.whole = machine.kernel(x, x) + 1

    def columns(self, i: np.ndarray) -> np.ndarray:
        out, step = np.empty((len(self.x), len(i))), max(1, BLOCK_CELLS // len(i))
        for at in range(0, len(self.x), step):
            out[at : at + step] = self.machine.kernel(self.x[at : at + step], self.x[i]) + 1
        return out

    def column(self, i: int) -> np.ndarray:
        return self.machine.kernel(self.x, self.x[i : i + 1])[:, 0] + 1

    def diagonal(self) -> np.ndarray:
        return self.machine.own(self.x) + 1

    def times(self, a: np.ndarray) -> np.ndarray:
        if self.whole is not None:
            return self.whole @ a
        if self.factor is not None:
            return self.factor.times(self.factor.back(a))
        step = max(1, BLOCK_CELLS // len(self.x))
        return np.concatenate([(self.machine.kernel(self.x[i : i + step], self.x) + 1) @ a for i in range(0, len(self.x), step)])

    def walk(self, t: np.ndarray):
        """The gradient's part at a row, what moves the row's dual value by d, and the diagonal; signs t."""
        k, g = self.whole if self.whole is None else self.whole * np.outer(t, t), np.zeros(len(t))

        def step(i, d):
            g.__iadd__(d * (k[:, i] if k is not None else t[i] * t * self.column(i)))

        return g.__getitem__, step, np.diag(k) if k is not None else self.diagonal()

    def short(self, a: np.ndarray) -> dict:
        """For margins of other rows through the pivots alone: their rows, their weights in a margin (one
        row for each of a's), the inverse of their triangle, and what a row's remainder weighs in a margin."""
        f = self.factor
        inverse = np.linalg.inv(np.tril(f.rows(f.pivots)))
        return {"pivots": self.x[f.pivots], "weights": np.stack([f.back(one) for one in a]) @ inverse, "inverse": inverse, "slack": np.abs(a) @ np.sqrt(f.left)}


class KernelMachine(Estimator):
    """Kernel machines: svmType 0 classification, 1 nu-classification, 2 one class, 3 epsilon and 4 nu regression; kernels 0 linear, 1 polynomial, 2 radial, 3 sigmoid; gamma 0 is 1 over the width."""

    family = "svm"
    defaults = {"svmType": 0, "kernel": 2, "C": 1.0, "gamma": 0.0, "degree": 3, "coef0": 0.0, "nu": 0.5, "p": 0.1}

    def kernel(self, a, b):
        g = self.param("gamma") or 1 / a.shape[1]
        kind = self.param("kernel")
        if kind == 2:
            return np.exp(-g * np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))
        dot = a @ b.T
        return dot if kind == 0 else (g * dot + self.param("coef0")) ** self.param("degree") if kind == 1 else np.tanh(g * dot + self.param("coef0"))

    def own(self, x):
        """The kernel of each row with itself."""
        if self.param("kernel") == 2:
            return np.ones(len(x))
        dot = (x * x).sum(1)
        g = self.param("gamma") or 1 / x.shape[1]
        return dot if self.param("kernel") == 0 else (g * dot + self.param("coef0")) ** self.param("degree") if self.param("kernel") == 1 else np.tanh(g * dot + self.param("coef0"))

    def _box(self, gram, t, high, linear, looks):
        """Coordinate ascent on the dual with the bias in the kernel, from 0 to `high`; t: the signs of the rows.

        All rows once, then those that can move, until none of all can or the duality gap is 1e-7 of the
        dual; `looks` bounds the rows looked at. Kernels that aren't semidefinite get 60 sweeps over all.
        """
        a, n = np.zeros(len(t)), len(t)
        sweep, diag = self._sweep_of_factor(gram.factor, t, high, linear) if gram.factor is not None else self._sweep(gram, t, high, linear)
        rows, rounds = np.random.default_rng(0).permutation(n), 1
        if not self.semidefinite:
            sweep(a, rows, 60)
            return a
        while len(rows) and looks > 0:
            sweep(a, rows, rounds)
            fit = gram.times(t * a)
            slope, looks = t * fit - linear, looks - n - rounds * len(rows)
            could = np.abs(np.clip(a - slope / diag, 0, high) - a)
            gap = float(a @ slope + high @ np.maximum(-slope, 0))
            if could.max(initial=0) < 1e-5 or gap <= 1e-7 * abs(float(linear @ a - (t * a) @ fit / 2)):
                break
            rows = np.random.default_rng(0).permutation(np.flatnonzero((could > 0) | (a > 0) & (a < high)))
            rounds = max(2, min(200, 2 * n // max(1, len(rows))))
        return a

    @staticmethod
    def _sweep(gram, t, high, linear):
        look, move, diag = gram.walk(t)
        diag = np.maximum(diag, 1e-9)
        limit, line, size = high.tolist(), linear.tolist(), diag.tolist()

        def sweep(a, rows, rounds):
            for _ in range(rounds):
                most = 0.0
                for i in rows.tolist():
                    old = a[i]
                    new = min(max(old - (look(i) - line[i]) / size[i], 0.0), limit[i])
                    if (d := new - old) != 0:
                        move(i, d)
                        a[i] = new
                        most = max(most, abs(d))
                if most < 1e-5:
                    break

        return sweep, diag

    @staticmethod
    def _sweep_of_factor(f, t, high, linear):
        diag = np.maximum(f.diagonal(), 1e-9)

        def sweep(a, rows, rounds):
            w, held, step = f.back(t * a), None, max(1, BLOCK_CELLS // max(1, f.width))
            if rounds > 1 and len(rows) * f.width <= 8 * BLOCK_CELLS:
                held, step = f.rows(rows), len(rows)
            for _ in range(rounds):
                most = 0.0
                for b in range(0, len(rows), step):
                    part = rows[b : b + step]
                    now = a[part].tolist()
                    looks = zip(held if held is not None else f.rows(part), now, t[part].tolist(), high[part].tolist(), linear[part].tolist(), diag[part].tolist(), strict=True)
                    for j, (row, old, sign, limit, line, size) in enumerate(looks):
                        new = min(max(old - (sign * float(row.dot(w)) - line) / size, 0.0), limit)
                        if (d := new - old) != 0:
                            w += (d * sign) * row
                            now[j] = new
                            most = max(most, abs(d))
                    a[part] = now
                if most < 1e-5:
                    break

        return sweep, diag

    @property
    def semidefinite(self) -> bool:
        return self.param("kernel") in (0, 2) or self.param("kernel") == 1 and self.param("coef0") >= 0

    def _fit(self, x, y, k):
        c, count = self.param("C"), np.ones(len(x))
        if k and self.param("svmType") == 1:
            c = 1 / max(1e-6, self.param("nu") * len(x)) * 10
        if many := len(x) ** 2 > GRAM_CELLS:  # equal rows are one with a wider box
            _, first, count = np.unique(np.column_stack([x, y]), axis=0, return_index=True, return_counts=True)
            order = np.argsort(first)
            x, y, count = x[first[order]], y[first[order]], count[order].astype(float)
        top, looks = c * count, 60 * int(count.sum())
        gram = Gram(self, x, top.sum(), many)
        if not k:
            p, plus = self.param("p"), np.ones(len(x))
            a = self._box(gram, plus, top, y - p, looks)
            b = np.zeros(len(x))
            for _ in range(20):  # the two sides of the tube in turn
                b = self._box(gram, plus, top, gram.times(a) - y - p, looks)
                new = self._box(gram, plus, top, y - p + gram.times(b), looks)
                if np.abs(new - a).max() < 1e-5:
                    break
                a = new
            return self._made(gram, (a - b)[None], count)
        rows = []
        for label in [1] if k == 2 else range(k):
            t = np.where(y == label, 1.0, -1.0)
            rows.append(t * self._box(gram, t, top, np.ones(len(x)), looks))
        return self._made(gram, np.stack(rows), count)

    @staticmethod
    def _made(gram, a, count):
        return {"x": gram.x, "a": a, "count": count} | (gram.short(a) if gram.factor is not None and gram.factor.width else {})

    def _margins(self, x, s):
        """Sums over the support vectors; through the pivots of a factor where that is sure to move no margin
        by more than MARGIN, nor over 0."""
        if "pivots" not in s:
            return self._sums(x, s)
        out, step = [], max(1, BLOCK_CELLS // len(s["pivots"]))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            near = self.kernel(part, s["pivots"]) + 1
            z = near @ s["weights"].T
            rest = np.maximum(self.own(part) + 1 - ((near @ s["inverse"].T) ** 2).sum(axis=1), 1e-12)
            apart = np.sqrt(rest)[:, None] * s["slack"]
            doubt = np.flatnonzero(~((apart <= MARGIN) & (np.abs(z) > apart)).all(axis=1))
            if len(doubt):
                z[doubt] = self._sums(part[doubt], s)
            out.append(z)
        return np.concatenate(out or [np.empty((0, len(s["a"])))])

    def _sums(self, x, s):
        """Sums over the support vectors, a block of rows at a time."""
        used = np.flatnonzero(np.abs(s["a"]).max(axis=0) > 0)
        rows, a = s["x"][used], s["a"][:, used].T
        step = max(1, BLOCK_CELLS // max(1, len(rows)))
        return np.concatenate([(self.kernel(x[i : i + step], rows) + 1) @ a for i in range(0, len(x), step)] or [np.empty((0, a.shape[1]))])

    def decision_function(self, x):
        s = self._ready()
        return self._margins(np.asarray(x, float), s)

    @property
    def sv_count(self) -> int:
        s = self._ready()
        used = np.abs(s["a"]).max(axis=0) > 1e-12
        return int((s["count"][used] if "count" in s else used).sum())

    def _predict(self, x, s):
        z = self._margins(x, s)
        if not s["classes"]:
            return z[:, 0]
        p = _sigmoid(2 * z)
        return np.column_stack([1 - p[:, 0], p[:, 0]]) if len(s["classes"]) == 2 else p / p.sum(axis=1, keepdims=True)


#: Rows that are looked up at once.
QUERY_BLOCK = 128


def nearest(x: np.ndarray, rows: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Places in `rows` and distances of the k nearest to each of x, equal distances by place.

    Rows are taken in blocks. A quick distance in single precision, good to `slack`, leaves out what
    can't be among the k; the rest gets its distance as a plain sum over the features.
    """
    x, rows = np.ascontiguousarray(x), np.ascontiguousarray(rows)
    flat, middle = metric == "l1", rows.mean(axis=0)
    with np.errstate(over="ignore", invalid="ignore"):
        near, near_rows = (x - middle).astype(np.float32), (rows - middle).astype(np.float32)
        sizes = [(np.abs(v) if flat else v * v).sum(axis=1) for v in (near, near_rows)]
        reach = sizes[0].astype(float) + sizes[1].max()
        shift = 8 * np.finfo(float).eps * (np.abs(x).sum(axis=1) + np.abs(rows).sum(axis=1).max())  # from taking off the middle
        slack = 4 * (x.shape[1] + 4) * float(np.finfo(np.float32).eps) * reach + (8 * shift if flat else 8 * np.sqrt(reach) * shift + 8 * shift**2)
        base = np.zeros(len(x)) if flat else sizes[0].astype(float)
        if not flat:  # |t|^2 - 2 x t, as one product
            near, near_rows = np.column_stack([-2 * near, np.ones(len(x), np.float32)]), np.column_stack([near_rows, sizes[1]])
        found = [_nearest(x[a : a + QUERY_BLOCK], near[a : a + QUERY_BLOCK], rows, near_rows, k, flat, base[a : a + QUERY_BLOCK], slack[a : a + QUERY_BLOCK]) for a in range(0, len(x), QUERY_BLOCK)]
    return np.concatenate([i for i, _ in found]), np.concatenate([d for _, d in found])


def _nearest(x, near, rows, near_rows, k, flat, base, slack):
    n, best, new, limit = len(x), [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)], [], None
    step = max(k, BLOCK_CELLS // (QUERY_BLOCK * max(4, x.shape[1])))
    for b in range(0, len(rows), step):
        part = near_rows[b : b + step]
        if flat:
            rough, one = np.zeros((n, len(part)), np.float32), np.empty((n, len(part)), np.float32)
            for f in range(x.shape[1]):
                np.subtract(near[:, f, None], part[None, :, f], out=one)
                rough += np.abs(one, out=one)
        else:
            rough = near @ part.T
        if limit is None:
            limit = np.partition(rough, k - 1, axis=1)[:, k - 1] + 2 * slack
        far = rough > np.nextafter(limit.astype(np.float32), np.float32(np.inf))[:, None]
        q, j = np.divmod(np.flatnonzero(~far), len(part))  # NaN stays
        if len(q):
            apart = x[q] - rows[b + j]
            new.append((q, j + b, np.abs(apart).sum(axis=1) if flat else np.sqrt((apart**2).sum(axis=1))))
        if sum(len(c[0]) for c in new) >= n * k or b + step >= len(rows):
            q, j, d = (np.concatenate(c) for c in zip(best, *new, strict=True))
            order = np.lexsort((j, d, q))
            q = q[order]
            first = order[np.arange(len(q)) - np.searchsorted(q, q) < k]
            best, new = [np.repeat(np.arange(n), k), j[first], d[first]], []
            limit = (best[2].reshape(n, k)[:, -1] ** (1 if flat else 2)) - base + slack
    return best[1].reshape(n, k), best[2].reshape(n, k)


class Neighbours(Estimator):
    """k nearest rows by l2 or l1: shares of labels, or the plain mean."""

    family = "knn"
    defaults = {"k": 5, "metric": "l2", "leafMaxSize": 10}

    def _fit(self, x, y, k):
        return {"x": x, "y": y.astype(np.float64)}

    def kneighbors(self, x, k=None):
        s = self._ready()
        x, k = np.asarray(x, float), min(k or self.param("k"), len(s["x"]))
        return nearest(x, s["x"], k, self.param("metric"))

    def _predict(self, x, s):
        labels = s["y"][self.kneighbors(x)[0]]
        if not s["classes"]:
            return labels.mean(axis=1)
        return np.stack([(labels == c).mean(axis=1) for c in range(len(s["classes"]))], axis=1)


def cut_points(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Inner quantile cuts of each column, distinct."""
    at = np.linspace(0, 1, bins + 1)[1:-1]
    return [np.unique(np.quantile(c, at)) for c in x.T]


def binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, v, "right") for c, v in zip(cuts, x.T, strict=True)], axis=1)


def grow_tree(
    b: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, min_leaf: float, penalty: float, features: int, rng, values=None,
    *, alpha: float = 0.0, min_weight: float = 0.0, min_split: int = 2, entropy: bool = False, random_cut: bool = False, leaves: int | None = None,
) -> np.ndarray:
    """A histogram tree on gradients: rows (feature, bin, left, right, value); feature -1 is a leaf.

    `values` makes leaves mean vectors of it (classes), weighted by h; else a leaf is
    -sum(g) / (sum(h) + penalty), sum(g) drawn to 0 by `alpha`. With `leaves`, the leaf that gains most
    is split next, until there are so many; else all are, down to `depth`. `random_cut` tries one
    place of each feature; `entropy` scores splits of class counts by it.
    """
    bins = int(b.max()) + 1 if b.size else 1
    nodes: list[list] = []

    def drawn(s):
        return np.sign(s) * np.maximum(np.abs(s) - alpha, 0) if alpha else s

    def worth(s, t):
        if g.ndim == 1:
            return drawn(s) ** 2 / (t + penalty)
        if entropy:
            c = np.maximum(-s, 0)
            return (c * np.log(np.maximum(c, 1e-12) / np.maximum(c.sum(axis=-1, keepdims=True), 1e-12))).sum(axis=-1)
        return (s**2).sum(axis=-1) / (t + penalty)

    def add(rows):
        value = -drawn(g[rows].sum()) / (h[rows].sum() + penalty) if values is None else 0.0
        nodes.append([-1, 0, 0, 0, value, *([] if values is None else np.average(values[rows], axis=0, weights=h[rows]))])
        return len(nodes) - 1

    def split(rows):
        """(gain, feature, bin) of the best split, or none."""
        best = (1e-12, None, None)
        if len(rows) < max(2 * min_leaf, min_split):
            return best
        total_g, total_h = g[rows].sum(axis=0), h[rows].sum()
        base = worth(total_g, total_h)
        for f in rng.permutation(b.shape[1])[:features]:
            column = b[rows, f]
            n = np.bincount(column, minlength=bins).cumsum()
            hs = np.bincount(column, weights=h[rows], minlength=bins).cumsum()
            if g.ndim == 1:
                gs = np.bincount(column, weights=g[rows], minlength=bins).cumsum()
            else:
                gs = np.stack([np.bincount(column, weights=g[rows, c], minlength=bins).cumsum() for c in range(g.shape[1])], axis=1)
            gain = worth(gs, hs) + worth(total_g - gs, total_h - hs) - base
            gain[(n < min_leaf) | (len(rows) - n < min_leaf) | (hs < min_weight) | (total_h - hs < min_weight)] = -1
            low, high = int(column.min()), int(column.max())
            at = int(rng.integers(low, high)) if random_cut and high > low else int(gain.argmax())
            if gain[at] > best[0]:
                best = (gain[at], int(f), at)
        return best

    def part(me, rows, found):
        left = b[rows, found[1]] <= found[2]
        nodes[me][:2] = found[1:]
        return rows[left], rows[~left]

    def build(rows, level):
        me = add(rows)
        if level and (found := split(rows))[1] is not None:
            low, high = part(me, rows, found)
            nodes[me][2] = build(low, level - 1)
            nodes[me][3] = build(high, level - 1)
        return me

    if leaves is None:
        build(np.arange(len(b)), depth)
    else:
        heap: list[tuple] = []

        def open_leaf(rows, level):
            me = add(rows)
            if level and (found := split(rows))[1] is not None:
                heapq.heappush(heap, (-found[0], me, level, rows, found))
            return me

        open_leaf(np.arange(len(b)), depth)
        for _ in range(leaves - 1):
            if not heap:
                break
            _, me, level, rows, found = heapq.heappop(heap)
            low, high = part(me, rows, found)
            nodes[me][2], nodes[me][3] = open_leaf(low, level - 1), open_leaf(high, level - 1)
    return np.array(nodes, dtype=np.float64)


def run_tree(nodes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The leaf (row of nodes) of each row."""
    at = np.zeros(len(b), dtype=np.int64)
    while True:
        inner = nodes[at, 0] >= 0
        if not inner.any():
            return at
        rows = np.flatnonzero(inner)
        f = nodes[at[rows], 0].astype(int)
        low = b[rows, f] <= nodes[at[rows], 1]
        at[rows] = np.where(low, nodes[at[rows], 2], nodes[at[rows], 3]).astype(int)


class _Trees(Estimator):
    bins = "max_bins"

    def _bins(self, x):
        cuts = cut_points(x, int(self.param(self.bins)))
        return {"cuts": cuts, "cut_sizes": np.array([len(c) for c in cuts])}, binned(x, cuts)


class Boosting(_Trees):
    """Gradient-boosted histogram trees: logistic, softmax or squared error; second-order leaves.

    `min_child_weight` is the least sum of second derivatives of a leaf; `num_parallel_tree` trees, each
    on its own sample, share a round.
    """

    family = "boosting"
    rate = "eta"
    defaults = {"numRound": 100, "eta": 0.1, "max_depth": 4, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_weight": 1, "lambda": 1.0, "alpha": 0.0, "num_parallel_tree": 1, "max_bins": 64, "seed": 0}

    def _tree(self, b, g, h, features, rng):
        return grow_tree(b, g, h, int(self.param("max_depth")), 1, self.param("lambda"), features, rng, alpha=self.param("alpha"), min_weight=self.param("min_child_weight"))

    def _fit(self, x, y, k):
        state, b = self._bins(x)
        rng, eta = np.random.default_rng(self.param("seed")), self.param(self.rate)
        width, side = 1 if k <= 2 else k, max(1, int(self.params.get("num_parallel_tree", 1)))
        base = np.zeros(width) if k else np.array([y.mean()])
        f = np.tile(base, (len(x), 1))
        trees = []
        features = max(1, round(self.param("colsample_bytree") * x.shape[1]))
        for _ in range(int(self.param("numRound"))):
            p = _softmax(f) if k > 2 else _sigmoid(f) if k else f
            for _ in range(side):
                rows = np.arange(len(x)) if self.param("subsample") >= 1 else np.flatnonzero(rng.random(len(x)) < self.param("subsample"))
                if not len(rows):
                    continue
                for c in range(width):
                    t = (y == (c if k > 2 else 1)).astype(float) if k else y
                    g = p[:, c] - t
                    h = p[:, c] * (1 - p[:, c]) if k else np.ones(len(x))
                    tree = self._tree(b[rows], g[rows], h[rows], features, rng)
                    tree[:, 4] /= side
                    f[:, c] += eta * tree[run_tree(tree, b), 4]
                    trees.append(tree)
        return state | {"base": base, "trees": trees}

    def _predict(self, x, s):
        b, width = binned(x, s["cuts"]), len(s["base"])
        f = np.tile(s["base"], (len(x), 1))
        for i, tree in enumerate(s["trees"]):
            f[:, i % width] += self.param(self.rate) * tree[run_tree(tree, b), 4]
        if not s["classes"]:
            return f[:, 0]
        if width == 1:
            p = _sigmoid(f[:, 0])
            return np.column_stack([1 - p, p])
        return _softmax(f)


class Leafwise(Boosting):
    """Boosted trees that split the leaf with the largest gain next, up to `num_leaves`; max_depth -1 is no limit."""

    family = "leafwise"
    rate = "learning_rate"
    defaults = {"numRound": 100, "learning_rate": 0.1, "num_leaves": 31, "max_depth": -1, "subsample": 1.0, "colsample_bytree": 1.0, "min_child_samples": 5, "min_child_weight": 1e-3, "reg_lambda": 0.0, "reg_alpha": 0.0, "max_bins": 255, "seed": 0}

    def _tree(self, b, g, h, features, rng):
        return grow_tree(
            b, g, h, int(self.param("max_depth")), self.param("min_child_samples"), max(1e-9, self.param("reg_lambda")), features, rng,
            alpha=self.param("reg_alpha"), min_weight=self.param("min_child_weight"), leaves=int(self.param("num_leaves")),
        )


class Forest(_Trees):
    """Random forest on histograms: bootstrap rows, sqrt, log2, third or all features at each split.

    `criterion` gini or entropy; `extra_trees` tries one random place of each feature;
    `class_weight="balanced"` weighs classes evenly; without `histogram_binning` every distinct value parts.
    """

    family = "forest"
    defaults = {"n_estimators": 100, "max_depth": 10, "max_features": "sqrt", "min_samples_split": 2, "min_samples_leaf": 1, "bootstrap": 1, "criterion": "gini", "extra_trees": 0, "class_weight": None, "histogram_binning": 1, "max_bins": 64, "seed": 0}

    def _bins(self, x):
        if self.param("histogram_binning"):
            return super()._bins(x)
        cuts = [(u[1:] + u[:-1]) / 2 for u in map(np.unique, x.T)]
        return {"cuts": cuts, "cut_sizes": np.array([len(c) for c in cuts])}, binned(x, cuts)

    def _fit(self, x, y, k):
        if self.param("criterion") not in ("gini", "entropy"):
            raise ValidationError(f"unknown criterion {self.param('criterion')!r}")
        state, b = self._bins(x)
        rng, d = np.random.default_rng(self.param("seed")), x.shape[1]
        m = {"sqrt": math.sqrt(d), "log2": math.log2(d + 1), "third": d / 3, "all": d, "auto": math.sqrt(d) if k else d / 3}[self.param("max_features")]
        target = np.eye(k)[y] if k else y[:, None]
        weight = len(y) / (k * np.bincount(y, minlength=k))[y] if k and self.param("class_weight") == "balanced" else np.ones(len(x))
        options = {"min_split": int(self.param("min_samples_split")), "entropy": bool(k) and self.param("criterion") == "entropy", "random_cut": bool(self.param("extra_trees"))}
        trees, out, seen = [], np.zeros((len(x), target.shape[1])), np.zeros(len(x))
        for _ in range(int(self.param("n_estimators"))):
            rows = rng.integers(0, len(x), len(x)) if self.param("bootstrap") else np.arange(len(x))
            t = (target[rows] - (0 if k else target.mean())) * weight[rows, None]
            tree = grow_tree(b[rows], -t, weight[rows], int(self.param("max_depth")), self.param("min_samples_leaf"), 1e-9, max(1, round(m)), rng, values=target[rows], **options)
            trees.append(tree)
            left_out = np.setdiff1d(np.arange(len(x)), rows)
            if len(left_out):
                out[left_out] += tree[run_tree(tree, b[left_out]), 5:]
                seen[left_out] += 1
        some = seen > 0
        oob = float("nan")
        if some.any():
            mean = out[some] / seen[some, None]
            oob = float((mean.argmax(1) == y[some]).mean()) if k else float(1 - ((y[some] - mean[:, 0]) ** 2).sum() / max(1e-12, ((y[some] - y[some].mean()) ** 2).sum()))
        return state | {"trees": trees, "oob": oob}

    @property
    def oob_score(self) -> float:
        return self._ready()["oob"]

    def leaves(self, x) -> np.ndarray:
        s = self._ready()
        b = binned(np.asarray(x, float), s["cuts"])
        return np.stack([run_tree(t, b) for t in s["trees"]], axis=1)

    def proximity(self, x) -> np.ndarray:
        leaves = self.leaves(x)
        return (leaves[:, None] == leaves[None]).mean(axis=2)

    def permutation_importance(self, x, y, seed: int = 0) -> np.ndarray:
        x, base, rng = np.array(x, float), self.score(x, y), np.random.default_rng(seed)
        out = []
        for f in range(x.shape[1]):
            mixed = x.copy()
            mixed[:, f] = rng.permutation(mixed[:, f])
            out.append(base - self.score(mixed, y))
        return np.array(out)

    def _predict(self, x, s):
        b = binned(x, s["cuts"])
        mean = sum(t[run_tree(t, b), 5:] for t in s["trees"]) / len(s["trees"])
        return mean if s["classes"] else mean[:, 0]


class Additive(_Trees):
    """Additive model by cyclic boosting: each round updates one feature's bins from their gradients."""

    family = "additive"
    bins = "maxBins"
    defaults = {"learningRate": 0.05, "maxRounds": 200, "maxBins": 32, "lambda": 1.0}

    def _fit(self, x, y, k):
        state, b = self._bins(x)
        rate, lam, width = self.param("learningRate"), self.param("lambda"), 1 if k <= 2 else k
        base = np.zeros(width) if k else np.array([y.mean()])
        f = np.tile(base, (len(x), 1))
        terms = [np.zeros((len(c) + 1, width)) for c in state["cuts"]]
        t = y[:, None] if not k else (y[:, None] == 1).astype(float) if k <= 2 else np.eye(k)[y]
        for _ in range(int(self.param("maxRounds"))):
            for j, term in enumerate(terms):
                p = _softmax(f) if k > 2 else _sigmoid(f) if k else f
                h = p * (1 - p) if k else np.ones_like(f)
                for c in range(width):
                    gs = np.bincount(b[:, j], weights=p[:, c] - t[:, c], minlength=len(term))
                    hs = np.bincount(b[:, j], weights=h[:, c], minlength=len(term))
                    step = -rate * gs / (hs + lam)
                    term[:, c] += step
                    f[:, c] += step[b[:, j]]
        for j, term in enumerate(terms):  # terms of mean 0
            mean = term[b[:, j]].mean(axis=0)
            term -= mean
            base = base + mean
        return state | {"base": base, "terms": terms}

    def explain(self, x) -> np.ndarray:
        """(rows, features, outputs) contributions."""
        s = self._ready()
        b = binned(np.asarray(x, float), s["cuts"])
        return np.stack([t[b[:, j]] for j, t in enumerate(s["terms"])], axis=1)

    def importances(self) -> np.ndarray:
        return np.array([np.abs(t).mean() for t in self._ready()["terms"]])

    def _predict(self, x, s):
        f = s["base"] + self.explain(x).sum(axis=1)
        if not s["classes"]:
            return f[:, 0]
        if f.shape[1] == 1:
            p = _sigmoid(f[:, 0])
            return np.column_stack([1 - p, p])
        return _softmax(f)


class Network(Estimator):
    """Dense network, trained on shuffled minibatches by Adam or plain gradient descent.

    members > 1 shares the weights between members that scale each layer's inputs and outputs and
    are averaged (batch ensemble).
    """

    family = "mlp"
    defaults = {"hidden_sizes": [64], "activation": "relu", "lr": 0.01, "epochs": 60, "optimizer": "adam", "batch": 32, "seed": 0, "members": 1}

    @staticmethod
    def act(name, z):
        """(value, derivative)."""
        if name == "relu":
            return np.maximum(z, 0), (z > 0).astype(float)
        if name == "silu":
            s = _sigmoid(z)
            return z * s, s * (1 + z * (1 - s))
        t = np.tanh(0.7978845608028654 * (z + 0.044715 * z**3))
        return 0.5 * z * (1 + t), 0.5 * (1 + t) + 0.5 * z * (1 - t**2) * 0.7978845608028654 * (1 + 3 * 0.044715 * z**2)

    def _forward(self, x, ws, ms):
        kept, a = [], np.broadcast_to(x, (ms, *x.shape)) if x.ndim == 2 else x
        for i in range(0, len(ws), 4):
            r, w, s, b = ws[i : i + 4]
            inner = a * r[:, None]
            z = inner @ w * s[:, None] + b[:, None]
            last = i + 4 >= len(ws)
            out, slope = (z, np.ones_like(z)) if last else self.act(self.param("activation"), z)
            kept.append((a, inner, slope))
            a = out
        return a, kept

    def _fit(self, x, y, k):
        rng = np.random.default_rng(self.param("seed"))
        ms = int(self.param("members"))
        mean, std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        x = (x - mean) / std
        shift, scale = (0.0, 1.0) if k else (y.mean(), y.std() or 1.0)
        t = np.eye(k)[y] if k else ((y - shift) / scale)[:, None]
        sizes = [x.shape[1], *self.param("hidden_sizes"), t.shape[1]]
        ws = []
        for a, b in zip(sizes, sizes[1:], strict=False):
            sign = rng.choice([-1.0, 1.0], (ms, a)) if ms > 1 and not ws else np.ones((ms, a))
            ws += [sign, rng.normal(0, math.sqrt(2 / a), (a, b)), np.ones((ms, b)), np.zeros((ms, b))]
        m, v, step = [np.zeros_like(w) for w in ws], [np.zeros_like(w) for w in ws], 0
        for _ in range(int(self.param("epochs"))):
            order = rng.permutation(len(x))
            for at in range(0, len(x), int(self.param("batch"))):
                rows = order[at : at + int(self.param("batch"))]
                out, kept = self._forward(x[rows], ws, ms)
                if k:
                    e = np.exp(out - out.max(2, keepdims=True))
                    d = e / e.sum(2, keepdims=True) - t[rows]
                else:
                    d = 2 * (out - t[rows])
                d = d / (len(rows) * ms)
                grads = [None] * len(ws)
                for i in range(len(ws) - 4, -1, -4):
                    r, w, s, _b = ws[i : i + 4]
                    a, inner, slope = kept[i // 4]
                    d = d * slope
                    back = d * s[:, None]
                    grads[i + 3] = d.sum(1)
                    grads[i + 2] = (d * (inner @ w)).sum(1) if ms > 1 else np.zeros_like(s)
                    grads[i + 1] = np.einsum("mna,mnb->ab", inner, back)
                    d = back @ w.T
                    grads[i] = (d * a).sum(1) if ms > 1 else np.zeros_like(r)
                    d = d * r[:, None]
                step += 1
                for j, g in enumerate(grads):
                    if self.param("optimizer") == "adam":
                        m[j], v[j] = 0.9 * m[j] + 0.1 * g, 0.999 * v[j] + 0.001 * g * g
                        ws[j] = ws[j] - self.param("lr") * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
                    else:
                        ws[j] = ws[j] - self.param("lr") * g
        return {"ws": ws, "mean": mean, "std": std, "shift": float(shift), "scale": float(scale), "members": ms}

    def _predict(self, x, s):
        out = self._forward((x - s["mean"]) / s["std"], s["ws"], s["members"])[0]
        if s["classes"]:
            e = np.exp(out - out.max(2, keepdims=True))
            return (e / e.sum(2, keepdims=True)).mean(0)
        return out.mean(0)[:, 0] * s["scale"] + s["shift"]


class EnsembleNetwork(Network):
    """A network of members that share weights and are averaged."""

    family = "tabm"
    defaults = Network.defaults | {"members": 16}


class NeuralAdditive(Network):
    """A sum of one small network for each feature: a network whose weights stay block-diagonal."""

    family = "nam"
    defaults = Network.defaults | {"hidden_sizes": [16], "epochs": 60}

    def _fit(self, x, y, k):
        mean, std = x.mean(0), np.where(x.std(0) > 0, x.std(0), 1)
        rng, h = np.random.default_rng(self.param("seed")), int(self.param("hidden_sizes")[0])
        z = (x - mean) / std
        d, width = x.shape[1], k or 1
        shift, scale = (0.0, 1.0) if k else (y.mean(), y.std() or 1.0)
        t = np.eye(k)[y] if k else ((y - shift) / scale)[:, None]
        w1, b1, w2, b2 = rng.normal(0, 1, (d, h)), rng.normal(0, 1, (d, h)), rng.normal(0, 1 / math.sqrt(h * d), (d, h, width)), np.zeros(width)
        ps = [w1, b1, w2, b2]
        m, v, step = [np.zeros_like(p) for p in ps], [np.zeros_like(p) for p in ps], 0
        for _ in range(int(self.param("epochs"))):
            order = rng.permutation(len(z))
            for at in range(0, len(z), int(self.param("batch"))):
                rows = order[at : at + int(self.param("batch"))]
                pre = z[rows][:, :, None] * ps[0] + ps[1]
                a, slope = self.act(self.param("activation"), pre)
                out = np.einsum("ndh,dhc->nc", a, ps[2]) + ps[3]
                g = (_softmax(out) - t[rows] if k else 2 * (out - t[rows])) / len(rows)
                back = np.einsum("nc,dhc->ndh", g, ps[2]) * slope
                grads = [np.einsum("ndh,nd->dh", back, z[rows]), back.sum(0), np.einsum("ndh,nc->dhc", a, g), g.sum(0)]
                step += 1
                for j, gr in enumerate(grads):
                    m[j], v[j] = 0.9 * m[j] + 0.1 * gr, 0.999 * v[j] + 0.001 * gr * gr
                    ps[j] = ps[j] - self.param("lr") * (m[j] / (1 - 0.9**step)) / (np.sqrt(v[j] / (1 - 0.999**step)) + 1e-8)
        return {"ps": ps, "mean": mean, "std": std, "shift": float(shift), "scale": float(scale)}

    def contributions(self, x) -> np.ndarray:
        s = self._ready()
        w1, b1, w2, _ = s["ps"]
        a, _ = self.act(self.param("activation"), ((np.asarray(x, float) - s["mean"]) / s["std"])[:, :, None] * w1 + b1)
        return np.einsum("ndh,dhc->ndc", a, w2)

    def _predict(self, x, s):
        out = self.contributions(x).sum(1) + s["ps"][3]
        return _softmax(out) if s["classes"] else out[:, 0] * s["scale"] + s["shift"]


class Factorisation(Estimator):
    """Factorisation machine on rows of unit length, trained by Adagrad; one against the rest."""

    family = "fm"
    defaults = {"lr": 0.2, "lambda": 2e-5, "k": 4, "epoch": 30, "opt": "adagrad", "seed": 0}

    def _scale(self, x):
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return x / np.where(n == 0, 1, n)

    def _margin(self, x, b, w, v):
        return b + x @ w + 0.5 * ((x @ v) ** 2 - (x * x) @ (v * v)).sum(1)

    def _one(self, x, t, regression):
        rng, lr, lam = np.random.default_rng(self.param("seed")), self.param("lr"), self.param("lambda")
        b, w, v = 0.0, np.zeros(x.shape[1]), rng.normal(0, 0.1, (x.shape[1], int(self.param("k"))))
        gb, gw, gv = 1e-8, np.full_like(w, 1e-8), np.full_like(v, 1e-8)
        for _ in range(int(self.param("epoch"))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 16):
                rows = order[a : a + 16]
                xs = x[rows]
                z = self._margin(xs, b, w, v)
                g = (z - t[rows] if regression else -t[rows] * _sigmoid(-t[rows] * z)) / len(rows)
                db, dw = g.sum(), xs.T @ g + lam * w
                s = xs @ v
                dv = xs.T @ (g[:, None] * s) - ((xs * xs).T @ g)[:, None] * v + lam * v
                if self.param("opt") == "sgd":
                    b, w, v = b - lr * db, w - lr * dw, v - lr * dv
                    continue
                gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
                b, w, v = b - lr * db / math.sqrt(gb), w - lr * dw / np.sqrt(gw), v - lr * dv / np.sqrt(gv)
        return b, w, v

    def _fit(self, x, y, k):
        x = self._scale(x)
        shift, scale = (0.0, 1.0) if k else (y.mean(), y.std() or 1.0)
        sides = [np.where(y == c, 1.0, -1.0) for c in ([1] if k == 2 else range(k))] if k else [(y - shift) / scale]
        parts = [self._one(x, t, not k) for t in sides]
        return {"b": np.array([p[0] for p in parts]), "w": np.stack([p[1] for p in parts]), "v": np.stack([p[2] for p in parts]), "shift": float(shift), "scale": float(scale)}

    def decision_function(self, x):
        s = self._ready()
        x = self._scale(np.asarray(x, float))
        return np.stack([self._margin(x, b, w, v) for b, w, v in zip(s["b"], s["w"], s["v"], strict=True)], axis=1)

    def _predict(self, x, s):
        z = self.decision_function(x)
        if not s["classes"]:
            return z[:, 0] * s["scale"] + s["shift"]
        p = _sigmoid(z)
        return np.column_stack([1 - p[:, 0], p[:, 0]]) if len(s["classes"]) == 2 else p / p.sum(1, keepdims=True)


class FieldFactorisation(Factorisation):
    """Field-aware factorisation machine: a feature has factors for each field; `fields` lists each feature's (its own place by default)."""

    family = "ffm"
    defaults = Factorisation.defaults | {"fields": None}

    def _fields(self, d):
        fields = list(self.param("fields") or range(d))
        if len(fields) != d:
            raise ValidationError(f"{d} features need as many fields")
        return np.array(fields)

    def _pairs(self, x, v, fields):
        """(rows, features, features): the products of pairs' factors, without their values."""
        own = v[:, fields]  # own[i, j]: factors of i for the field of j
        return np.einsum("ijk,jik->ij", own, own)

    def _margin(self, x, b, w, v):
        dots = np.triu(self._pairs(x, v, self._fields(x.shape[1])), 1)
        return b + x @ w + np.einsum("ni,ij,nj->n", x, dots, x)

    def _one(self, x, t, regression):
        rng, lr, lam = np.random.default_rng(self.param("seed")), self.param("lr"), self.param("lambda")
        d, fields = x.shape[1], self._fields(x.shape[1])
        b, w, v = 0.0, np.zeros(d), rng.normal(0, 0.1, (d, int(fields.max()) + 1, int(self.param("k"))))
        gb, gw, gv = 1e-8, np.full_like(w, 1e-8), np.full_like(v, 1e-8)
        for _ in range(int(self.param("epoch"))):
            order = rng.permutation(len(x))
            for a in range(0, len(x), 16):
                rows = order[a : a + 16]
                xs = x[rows]
                z = self._margin(xs, b, w, v)
                g = (z - t[rows] if regression else -t[rows] * _sigmoid(-t[rows] * z)) / len(rows)
                both = np.einsum("n,ni,nj->ij", g, xs, xs)
                np.fill_diagonal(both, 0)
                dv = lam * v
                for j in range(d):  # feature i meets j with its factors for j's field
                    dv[:, fields[j]] += both[:, [j]] * v[j][fields]
                db, dw = g.sum(), xs.T @ g + lam * w
                gb, gw, gv = gb + db * db, gw + dw * dw, gv + dv * dv
                b, w, v = b - lr * db / math.sqrt(gb), w - lr * dw / np.sqrt(gw), v - lr * dv / np.sqrt(gv)
        return b, w, v


class Clauses(Estimator):
    """Tsetlin machine: clauses of threshold literals vote; automata learn by type I and II feedback."""

    family = "clauses"
    defaults = {"nClauses": 40, "threshold": 15, "s": 4.0, "nThresholdsPerFeature": 6, "nEpochs": 25, "stateBits": 8, "boostTruePositiveFeedback": False, "seed": 0}

    def _literals(self, x, cuts):
        bits = np.concatenate([x[:, [j]] > c[None] for j, c in enumerate(cuts)], axis=1)
        return np.concatenate([bits, ~bits], axis=1)

    def _fit(self, x, y, k):
        rng = np.random.default_rng(self.param("seed"))
        cuts = [np.unique(np.quantile(c, np.linspace(0, 1, min(int(self.param("nThresholdsPerFeature")), len(np.unique(c)) - 1) + 2)[1:-1])) if len(np.unique(c)) > 1 else np.array([c[0]]) for c in x.T]
        bits = self._literals(x, cuts)
        n, half, top, s = int(self.param("nClauses")), int(self.param("nClauses")) // 2, self.param("threshold"), self.param("s")
        limit = 1 << (int(self.param("stateBits")) - 1)
        outputs = max(1, k)
        state = np.zeros((outputs, n, bits.shape[1]), dtype=np.int32)  # positive: included
        sign = np.where(np.arange(n) < half, 1, -1)
        low, high = (0.0, 1.0) if k else (float(y.min()), float(y.max()) if y.max() > y.min() else float(y.min()) + 1)

        def feed(c, row, toward):
            """Raise (toward = 1) or lower the votes of output c on a row."""
            include = state[c] > 0
            fired = ~(include & ~row).any(axis=1)
            v = int(np.clip((sign * fired).sum(), -top, top))
            chance = (top - v) / (2 * top) if toward > 0 else (top + v) / (2 * top)
            picked = rng.random(n) < chance
            learn = picked & (sign == toward)
            for j in np.flatnonzero(learn & fired):
                state[c, j] += np.where(row, rng.random(len(row)) < (1.0 if self.param("boostTruePositiveFeedback") else (s - 1) / s), -(rng.random(len(row)) < 1 / s).astype(np.int32)).astype(np.int32)
            for j in np.flatnonzero(learn & ~fired):
                state[c, j] -= (rng.random(len(row)) < 1 / s).astype(np.int32)
            for j in np.flatnonzero(picked & (sign != toward) & fired):
                state[c, j] += (~row & (state[c, j] <= 0)).astype(np.int32)
            np.clip(state[c], -limit, limit, out=state[c])

        for _ in range(int(self.param("nEpochs"))):
            for i in rng.permutation(len(x)):
                if k:
                    feed(y[i], bits[i], 1)
                    other = int(rng.integers(k - 1))
                    feed(other + (other >= y[i]), bits[i], -1)
                else:
                    include = state[0] > 0
                    v = np.clip((sign * ~(include & ~bits[i]).any(axis=1)).sum(), 0, top) / top
                    aim = (y[i] - low) / (high - low)
                    if rng.random() < min(1.0, abs(aim - v) * 3):
                        feed(0, bits[i], 1 if aim > v else -1)
        return {"cuts": cuts, "include": state > 0, "low": low, "high": high}

    def _predict(self, x, s):
        bits = self._literals(x, s["cuts"])
        sign = np.where(np.arange(s["include"].shape[1]) < s["include"].shape[1] // 2, 1, -1)
        votes = []
        for inc in s["include"]:
            miss = (~bits).astype(np.float32) @ inc.T.astype(np.float32)
            votes.append((((miss == 0) & inc.any(axis=1)) * sign).sum(axis=1))
        v = np.stack(votes, axis=1).astype(float)
        top = self.param("threshold")
        return _softmax(np.clip(v, -top, top) / top * 4) if s["classes"] else s["low"] + np.clip(v[:, 0], 0, top) / top * (s["high"] - s["low"])


class BayesianTrees(_Trees):
    """Sum of shallow trees sampled by backfitting: each tree in turn is grown, pruned or kept by a
    Metropolis step, and its leaves are drawn from their posterior. Two classes go by a probit (data
    augmentation); predictions are means over the kept samples.
    """

    family = "bart"
    defaults = {"numTrees": 30, "numBurnin": 40, "numSamples": 40, "alpha": 0.95, "beta": 2.0, "minSamplesLeaf": 3, "max_bins": 32, "seed": 0}

    def _fit(self, x, y, k):
        if k > 2:
            raise ValidationError("the model takes two classes or numbers")
        state, b = self._bins(x)
        rng, m = np.random.default_rng(self.param("seed")), int(self.param("numTrees"))
        shift, scale = (0.0, 1.0) if k else (float(y.mean()), float(y.std()) or 1.0)
        z = (y * 2.0 - 1.0) if k else (y - shift) / scale
        prior, noise = (3.0 if k else 0.5 * (z.max() - z.min() + 1e-9)) ** 2 / (4 * m), 1.0 if k else 0.5
        trees = [np.array([[-1, 0, 0, 0, 0.0]]) for _ in range(m)]
        fits = np.zeros((m, len(x)))
        kept: list[np.ndarray] = []
        for step in range(int(self.param("numBurnin")) + int(self.param("numSamples"))):
            for t in range(m):
                rest = z - fits.sum(0) + fits[t]
                tree = self._propose(trees[t], b, rest, prior, noise, rng)
                at = run_tree(tree, b)
                n = np.bincount(at, minlength=len(tree))
                s = np.bincount(at, weights=rest, minlength=len(tree))
                var = 1 / (1 / prior + n / noise)
                tree[:, 4] = var * s / noise + np.sqrt(var) * rng.normal(size=len(tree))
                trees[t], fits[t] = tree, tree[at, 4]
            total = fits.sum(0)
            if k:
                u = total + rng.normal(size=len(x))
                flip = (u > 0) != (y == 1)
                z = np.where(flip, total + np.where(y == 1, 1, -1) * np.abs(rng.normal(size=len(x))) * 0.8, u)
            else:
                noise = (0.1 + ((z - total) ** 2).sum()) / rng.chisquare(len(x) + 3)
            if step >= self.param("numBurnin"):
                kept += [tr.copy() for tr in trees]
        return state | {"trees": kept, "shift": shift, "scale": scale, "samples": int(self.param("numSamples"))}

    def _evidence(self, at, size, rest, prior, noise):
        n = np.bincount(at, minlength=size)
        s = np.bincount(at, weights=rest, minlength=size)
        some = n > 0
        return float((0.5 * np.log(noise / (noise + prior * n[some])) + 0.5 * prior * s[some] ** 2 / (noise * (noise + prior * n[some]))).sum())

    def _propose(self, tree, b, rest, prior, noise, rng):
        """Grow a leaf, or prune a node above two leaves; the depth prior is alpha (1 + depth)^-beta."""
        alpha, beta = self.param("alpha"), self.param("beta")
        at = run_tree(tree, b)
        leaves = np.flatnonzero(tree[:, 0] < 0)
        depth = np.zeros(len(tree))
        for i in range(len(tree)):
            if tree[i, 0] >= 0:
                depth[int(tree[i, 2])] = depth[int(tree[i, 3])] = depth[i] + 1
        odds = lambda d: alpha * (1 + d) ** -beta
        if len(leaves) == 1 or rng.random() < 0.5:
            leaf = int(rng.choice(leaves))
            rows = np.flatnonzero(at == leaf)
            if len(rows) < 2 * self.param("minSamplesLeaf"):
                return tree.copy()
            f = int(rng.integers(b.shape[1]))
            cut = int(rng.choice(b[rows, f]))
            low = b[rows, f] <= cut
            if min(low.sum(), (~low).sum()) < self.param("minSamplesLeaf"):
                return tree.copy()
            new = np.vstack([tree, [-1, 0, 0, 0, 0.0], [-1, 0, 0, 0, 0.0]])
            new[leaf, :4] = f, cut, len(tree), len(tree) + 1
            p = odds(depth[leaf])
            ratio = np.log(p / (1 - p)) + 2 * np.log(1 - odds(depth[leaf] + 1))
        else:
            ends = [i for i in range(len(tree)) if tree[i, 0] >= 0 and tree[int(tree[i, 2]), 0] < 0 and tree[int(tree[i, 3]), 0] < 0]
            i = int(rng.choice(ends))
            gone = sorted((int(tree[i, 2]), int(tree[i, 3])))
            new = tree.copy()
            new[i, 0] = -1
            new = np.delete(new, gone, axis=0)
            for c in (2, 3):
                inner = new[:, 0] >= 0
                new[inner, c] -= (new[inner, c] > gone[0]).astype(float) + (new[inner, c] > gone[1]).astype(float)
            p = odds(depth[i])
            ratio = -(np.log(p / (1 - p)) + 2 * np.log(1 - odds(depth[i] + 1)))
        gain = self._evidence(run_tree(new, b), len(new), rest, prior, noise) - self._evidence(at, len(tree), rest, prior, noise)
        return new if np.log(rng.random()) < gain + ratio else tree.copy()

    def _predict(self, x, s):
        b = binned(x, s["cuts"])
        mean = sum(t[run_tree(t, b), 4] for t in s["trees"]) / s["samples"]
        if not s["classes"]:
            return mean * s["scale"] + s["shift"]
        p = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in mean])
        return np.column_stack([1 - p, p])


FAMILIES: dict[str, type[Estimator]] = {c.family: c for c in (Baseline, Linear, KernelMachine, Neighbours, Boosting, Leafwise, Forest, Additive, Network, EnsembleNetwork, NeuralAdditive, Factorisation, FieldFactorisation, Clauses, BayesianTrees)}
for _family, _class in FAMILIES.items():
    register(f"lathe.{_family}@1", _class.restore)


def create(family: str, task: str | None = None, **params) -> Estimator:
    if family not in FAMILIES:
        raise ValidationError(f"unknown model {family!r}; there are {', '.join(sorted(FAMILIES))}")
    return FAMILIES[family](task, **params)
