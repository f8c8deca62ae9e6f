"""Search over candidates: cross-validated scores, out-of-fold predictions, ensembles.

Candidates times folds are the rows of a frame; each row is fitted in a task, so one job evaluates a
whole round. The training matrix goes to the tasks as one broadcast and only while it has at most
`max_cells` values; beyond that `lathe.operators.distributed` fits the candidates over the cluster,
one after another.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.errors import ValidationError
from lathe.functions.rng import first_shuffled, lcg, seed_for
from lathe.operators import ensembles as en
from lathe.operators import frames as fr
from lathe.operators import search as se
from lathe.operators.estimators import Estimator, create
from lathe.operators.scaling import Preprocessor
from lathe.sources.bundle import encode_bundle
from lathe.sources.registry import load, register

MAX_CELLS = 20_000_000


@dataclass
class Matrix:
    """Rows gathered for local fits, in order of their id."""

    ids: np.ndarray
    x: np.ndarray
    y: np.ndarray
    fold: np.ndarray
    task: str

    @classmethod
    def gather(cls, df: DataFrame, row_id: str, features: list[str], y: str, folds: int | str = 5, seed: int = 42, task: str | None = None, max_cells: int = MAX_CELLS) -> Matrix:
        fr.validate_features(df, features)
        task = task or fr.detect_task(df, y)
        df = fr.normalise(df, features)
        column = folds if isinstance(folds, str) else "_fold"
        if not isinstance(folds, str):
            df = fr.stratified_k_fold(df, row_id, y, folds, seed, column) if task == "classification" else fr.k_fold(df, row_id, folds, seed, column)
        if df.count() * len(features) > max_cells:
            raise ValidationError(f"more than {max_cells} values; use lathe.operators.distributed")
        t = df.select(row_id, *features, y, column).orderBy(row_id).toArrow()
        x = np.stack([t[c].to_numpy().astype(np.float64) for c in features], axis=1)
        if np.isnan(x).any():
            raise ValidationError("missing values; put a Preprocessor first")
        return cls(t[row_id].to_numpy(), x, t[y].to_numpy(), t[column].to_numpy(), task)


def _score(y: np.ndarray, p: np.ndarray, proba, classes, scoring: str) -> float:
    if scoring == "accuracy":
        return float((y == p).mean())
    if scoring == "r2":
        total = ((y - y.mean()) ** 2).sum()
        return float(1 - ((y - p) ** 2).sum() / total) if total else 0.0
    if scoring == "neg_mse":
        return -float(((y - p) ** 2).mean())
    if scoring == "neg_mae":
        return -float(np.abs(y - p).mean())
    if scoring == "neg_logloss":
        at = {c: i for i, c in enumerate(classes)}
        own = np.array([proba[i, at[v]] if v in at else 0.0 for i, v in enumerate(y.tolist())])
        return float(np.log(np.clip(own, 1e-15, 1 - 1e-15)).mean())
    raise ValidationError(f"unknown scorer {scoring!r}")


def evaluate(df_source, data: Matrix, candidates: list[tuple[int, str, dict, float]], scoring: str | None = None, seed: int = 42, folds: list[int] | None = None, with_predictions: bool = False) -> list[dict]:
    """A dict for each (candidate, fold): id, fold, score, fit_ms, error and, if asked for, predictions.

    Candidates are (id, model, params, fraction of the training rows). A candidate that fails has an
    error and no score.
    """
    spark = df_source
    scoring = scoring or ("accuracy" if data.task == "classification" else "r2")
    folds = sorted(set(data.fold.tolist())) if folds is None else folds
    tasks = [(i, m, json.dumps(p), f, float(share)) for i, m, p, share in candidates for f in folds]
    every = sorted(set(data.y.tolist())) if data.task == "classification" else []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, m, p, f, share in batch[["id", "model", "params", "fold", "share"]].itertuples(index=False):
                began, row = time.time(), {"id": i, "fold": f, "score": None, "fit_ms": 0.0, "error": None, "predictions": None}
                try:
                    train, test = np.flatnonzero(data.fold != f), np.flatnonzero(data.fold == f)
                    if share < 1:
                        keep = max(1, int(np.ceil(len(train) * share)))
                        train = np.array(sorted(first_shuffled(train.tolist(), keep, lcg(seed_for(f"{m}:{p}", int(f), seed)))))
                    model = create(m, data.task, **json.loads(p)).fit(data.x[train], data.y[train])
                    proba = model.predict_proba(data.x[test]) if data.task == "classification" else None
                    classes = model.classes if proba is not None else []
                    p_hat = np.asarray(classes)[proba.argmax(axis=1)] if proba is not None else model.predict(data.x[test])
                    row["score"] = _score(data.y[test], p_hat, proba, classes, scoring)
                    if with_predictions:
                        full = np.zeros((len(test), len(every))) if proba is not None else np.asarray(p_hat, float)[:, None]
                        for j, c in enumerate(classes):  # by class, so a fold without some class lines up
                            full[:, every.index(c)] = proba[:, j]
                        row["predictions"] = full.ravel().tolist()
                except Exception as e:  # noqa: BLE001  a candidate's failure is its result
                    row["error"] = f"{type(e).__name__}: {e}"[:500]
                row["fit_ms"] = (time.time() - began) * 1000
                out.append(row)
            yield pd.DataFrame(out, columns=["id", "fold", "score", "fit_ms", "error", "predictions"])

    frame = spark.createDataFrame(tasks, "id long, model string, params string, fold long, share double").repartition(min(len(tasks), 2 * spark.sparkContext.defaultParallelism))
    return [r.asDict() for r in frame.mapInPandas(run, "id long, fold long, score double, fit_ms double, error string, predictions array<double>").collect()]


def cross_val_score(spark, df: DataFrame, row_id: str, features: list[str], y: str, model: str, params: dict | None = None, cv: int | str = 5, scoring: str | None = None, seed: int = 42) -> list[float]:
    """A model's score on each fold; cv is a number of folds (stratified for classes) or a fold column."""
    data = Matrix.gather(df, row_id, features, y, cv, seed)
    rows = sorted(evaluate(spark, data, [(0, model, params or {}, 1.0)], scoring, seed), key=lambda r: r["fold"])
    if failed := next((r["error"] for r in rows if r["error"]), None):
        raise ValidationError(failed)
    return [r["score"] for r in rows]


#: The parameter of each family that a budget of rounds sets.
ROUNDS = {"boosting": "numRound", "forest": "n_estimators", "additive": "maxRounds", "mlp": "epochs", "tabm": "epochs", "nam": "epochs", "fm": "epoch", "ffm": "epoch", "clauses": "nEpochs", "bart": "numSamples"}


def with_rounds(model: str, params: dict, rounds: int) -> dict:
    """Parameters under a budget of rounds; a candidate's own value wins."""
    return {ROUNDS[model]: rounds} | params if model in ROUNDS else dict(params)


@dataclass
class Search:
    """Results of candidates so far, and the best of them on all rows."""

    data: Matrix
    rows: list[dict] = field(default_factory=list)

    def board(self) -> list[dict]:
        """Ranked: those on all rows first, by mean score, then by id."""
        out = []
        for r in self.rows:
            scores = r["scores"]
            ok = r["error"] is None and scores
            out.append(r | {"mean": float(np.mean(scores)) if ok else float("-inf"), "std": float(np.std(scores)) if ok else 0.0})
        out.sort(key=lambda r: (-r["fraction"], -r["mean"], r["id"]))
        return [r | {"rank": i + 1} for i, r in enumerate(out)]

    def best(self) -> dict:
        top = self.board()
        if not top or top[0]["mean"] == float("-inf"):
            raise ValidationError("no candidate could be evaluated")
        return top[0]


def _collect(search: Search, candidates, found: list[dict], fraction: float) -> list[float]:
    means = []
    for i, m, p, _ in candidates:
        mine = sorted((r for r in found if r["id"] == i), key=lambda r: r["fold"])
        error = next((r["error"] for r in mine if r["error"]), None)
        scores = [r["score"] for r in mine if r["score"] is not None]
        search.rows.append({"id": len(search.rows), "candidate": i, "model": m, "params": p, "scores": scores, "fit_ms": sum(r["fit_ms"] for r in mine), "error": error, "fraction": fraction})
        means.append(float(np.mean(scores)) if scores and not error else float("-inf"))
    return means


def run_search(spark, data: Matrix, spaces: dict[str, dict] | list[str], strategy: str = "random", n_iter: int = 20, seed: int = 42, factor: int = 3, scoring: str | None = None, timeout: float | None = None, on_progress: Callable | None = None) -> Search:
    """random, halving, progressive or portfolio. A strategy's rounds are one job each; the timeout is checked between rounds."""
    spaces = {m: se.SPACES.get(m, {}) for m in spaces} if isinstance(spaces, list) else spaces
    search, began, n = Search(data), time.time(), len(data.x)
    if strategy == "portfolio":
        pool = [(m, c) for m in spaces for c in se.portfolio_of(m, data.task)]
    else:
        pool = se.random_candidates(spaces, n_iter, seed)
    candidates = [(i, m, p, 1.0) for i, (m, p) in enumerate(pool)]

    def step(some, fraction, folds=None):
        found = evaluate(spark, data, [(i, m, p, fraction) for i, m, p, _ in some], scoring, seed, folds)
        means = _collect(search, some, found, fraction if folds is None else 0.0)
        if on_progress:
            on_progress({"phase": "search", "evaluated": len(search.rows), "fraction": fraction})
        return means

    late = lambda share=1.0: timeout is not None and time.time() - began > share * timeout
    if strategy in ("random", "portfolio"):
        for at in range(0, len(candidates), 64):
            step(candidates[at : at + 64], 1.0)
            if late():
                break
    elif strategy == "halving":
        for r in se.halving_schedule(len(candidates), factor, len(set(data.fold.tolist())), n):
            means = step(candidates, min(1.0, r["resources"] / n))
            order = sorted(range(len(candidates)), key=lambda k: (-means[k], candidates[k][0]))[: r["survivors"]]
            candidates = [candidates[k] for k in sorted(order)]
            if late():
                break
    elif strategy == "progressive":
        means = step(candidates, 0.5, folds=[int(min(data.fold))])
        order = sorted(range(len(candidates)), key=lambda k: (-means[k], candidates[k][0]))[:10]
        step([candidates[k] for k in sorted(order)], 1.0)
    else:
        raise ValidationError(f"unknown strategy {strategy!r}")
    return search


def run_strategy(spark, data: Matrix, strategy, scoring: str | None = None, seed: int = 42, timeout: float | None = None, on_progress: Callable | None = None) -> Search:
    """Pulls candidates from the caller's own strategy until it is done, has none left, or time is up.

    A strategy has `next()`, which gives (model, params), a list of them that one job evaluates
    together, or None; `report(row)`, called with the result of each candidate that didn't fail (its
    candidate number, model, params, scores and mean); and `is_done()`. Failed candidates are on the
    board with their error and are not reported.
    """
    search, began, seen = Search(data), time.time(), 0
    while not strategy.is_done():
        if timeout is not None and time.time() - began > timeout:
            break
        pulled = strategy.next()
        if not pulled:
            break
        batch = pulled if isinstance(pulled, list) else [pulled]
        candidates = [(seen + i, m, p, 1.0) for i, (m, p) in enumerate(batch)]
        seen += len(batch)
        means = _collect(search, candidates, evaluate(spark, data, candidates, scoring, seed), 1.0)
        for row, mean in zip(search.rows[-len(batch) :], means, strict=True):
            if mean > float("-inf"):
                strategy.report(row | {"mean": mean})
        if on_progress:
            on_progress({"phase": "search", "evaluated": len(search.rows), "fraction": 1.0})
    return search


def out_of_fold(spark, data: Matrix, specs: list[tuple[str, dict]], seed: int = 42) -> list[np.ndarray]:
    """For each spec, predictions of each row by models that didn't see it: (rows, classes) or (rows,)."""
    found = evaluate(spark, data, [(i, m, p, 1.0) for i, (m, p) in enumerate(specs)], seed=seed, with_predictions=True)
    out = []
    for i in range(len(specs)):
        mine = [r for r in found if r["id"] == i]
        if any(r["error"] for r in mine):
            raise ValidationError(next(r["error"] for r in mine if r["error"]))
        width = len(mine[0]["predictions"]) // int((data.fold == mine[0]["fold"]).sum())
        full = np.zeros((len(data.x), width))
        for r in mine:
            full[data.fold == r["fold"]] = np.array(r["predictions"]).reshape(-1, width)
        out.append(full if data.task == "classification" else full[:, 0])
    return out


class _Nested(Estimator):
    """Estimators that hold others: their bundles are artifacts of this one's."""

    def _plain(self) -> dict:
        raise NotImplementedError

    def save(self) -> bytes:
        s = self._ready()
        parts = [{"id": f"model{i:04d}", "data": m.save()} for i, m in enumerate(s["models"])]
        if "meta" in s:
            parts.append({"id": "zmeta", "data": s["meta"].save()})
        if "oof" in s:
            parts.append({"id": "oof", "data": np.ascontiguousarray(s["oof"], "<f8").tobytes()})
        plain = {k: s[k] for k in ("task", "width", "classes")} | {"k": s.get("k", 0), "oof": list(s["oof"].shape) if "oof" in s else None}
        return encode_bundle({"typeId": f"lathe.{self.family}@1", "params": self._plain(), "metadata": plain}, parts)

    @classmethod
    def restore(cls, manifest, _toc, blobs) -> Estimator:
        plain = manifest["metadata"]
        made = cls(**manifest["params"])
        made.state = {k: plain[k] for k in ("task", "width", "classes", "k")}
        made.state["models"] = [load(blobs[i]) for i in sorted(blobs) if i.startswith("model")]
        if "zmeta" in blobs:
            made.state["meta"] = load(blobs["zmeta"])
        if plain["oof"]:
            made.state["oof"] = np.frombuffer(blobs["oof"], "<f8").reshape(plain["oof"])
        return made


class Voting(_Nested):
    """Weighted vote of fitted estimators: soft or hard; the weighted sum for numbers."""

    family = "voting"

    def __init__(self, specs, weights=None, voting: str = "soft", task: str | None = None):
        super().__init__(task)
        self.specs, self.voting = list(specs), voting
        self.weights = [1 / len(self.specs)] * len(self.specs) if weights is None else list(weights)
        if len(self.weights) != len(self.specs):
            raise ValidationError("as many weights as models are needed")

    def _plain(self) -> dict:
        return {"specs": self.specs, "weights": self.weights, "voting": self.voting, "task": self.task}

    def _fit(self, x, y, k):
        task = "classification" if k else "regression"
        return {"models": [create(m, task, **p).fit(x, y) for m, p in self.specs]}

    def predict_proba(self, x):
        if self._ready()["classes"] and self.voting == "hard":
            raise ValidationError("a hard vote has no probabilities")
        return super().predict_proba(x)

    def predict(self, x):
        s = self._ready()
        return np.asarray(s["classes"])[self._scores(x).argmax(axis=1)] if s["classes"] else self._scores(x)

    def _predict(self, x, s):
        if not s["classes"]:
            return sum(w * m.predict(x) for w, m in zip(self.weights, s["models"], strict=True))
        ps = [m.predict_proba(x) for m in s["models"]]
        if self.voting == "hard":
            ps = [np.eye(p.shape[1])[p.argmax(axis=1)] for p in ps]
        return sum(w * p for w, p in zip(self.weights, ps, strict=True))


class Bagged(_Nested):
    """The mean of models fitted on the training parts of k folds, repeated with other seeds."""

    family = "bagged"

    def __init__(self, spec, k_fold: int = 5, repeats: int = 1, seed: int = 42, task: str | None = None):
        super().__init__(task)
        self.spec, self.k, self.repeats, self.seed = spec, k_fold, repeats, seed

    def _plain(self) -> dict:
        return {"spec": self.spec, "k_fold": self.k, "repeats": self.repeats, "seed": self.seed, "task": self.task}

    def _fit(self, x, y, k):
        model, params = self.spec
        task = "classification" if k else "regression"
        width = k or 1
        total, seen, models = np.zeros((len(x), width)), np.zeros(len(x)), []
        for r in range(self.repeats):
            fold = np.random.default_rng(self.seed + r).permutation(len(x)) % self.k
            for f in range(self.k):
                m = create(model, task, **params).fit(x[fold != f], y[fold != f])
                models.append(m)
                p = m.predict_proba(x[fold == f]) if k else m.predict(x[fold == f])[:, None]
                rows = np.flatnonzero(fold == f)
                for j, c in enumerate(m.classes if k else [0]):
                    total[rows, int(c)] += p[:, j]
                seen[rows] += 1
        return {"models": models, "oof": total / np.maximum(seen, 1)[:, None], "k": k}

    @property
    def oof_predictions(self) -> np.ndarray:
        return self._ready()["oof"]

    def _predict(self, x, s):
        out = np.zeros((len(x), s["k"] or 1))
        for m in s["models"]:
            p = m.predict_proba(x) if s["k"] else m.predict(x)[:, None]
            for j, c in enumerate(m.classes if s["k"] else [0]):
                out[:, int(c)] += p[:, j] / len(s["models"])
        return out if s["k"] else out[:, 0]


class Stacking(_Nested):
    """A meta-model on out-of-fold predictions (model by model, class by class), and x if passed through.

    A member may be (name, fitted Bagged): its out-of-fold predictions on the same rows are used.
    """

    family = "stacking"

    def __init__(self, specs, meta=("linear", {}), cv: int = 5, passthrough: bool = False, seed: int = 42, task: str | None = None):
        super().__init__(task)
        self.specs, self.meta, self.cv, self.passthrough, self.seed = list(specs), meta, cv, passthrough, seed

    def _plain(self) -> dict:
        specs = [(m, "bagged") if isinstance(p, Bagged) else (m, p) for m, p in self.specs]
        return {"specs": specs, "meta": self.meta, "cv": self.cv, "passthrough": self.passthrough, "seed": self.seed, "task": self.task}

    def _fit(self, x, y, k):
        bags = [s[1] if isinstance(s[1], Bagged) else Bagged(s, self.cv, 1, self.seed, "classification" if k else "regression").fit(x, y) for s in self.specs]
        if any(len(b.oof_predictions) != len(x) for b in bags):
            raise ValidationError("a fitted member was bagged on other rows")
        table = np.concatenate([b.oof_predictions for b in bags] + ([x] if self.passthrough else []), axis=1)
        task = "classification" if k else "regression"
        return {"models": [p if isinstance(p, Bagged) else create(m, task, **p).fit(x, y) for m, p in self.specs], "meta": create(self.meta[0], task, **self.meta[1]).fit(table, y)}

    def meta_features(self, x, s) -> np.ndarray:
        parts = [m.predict_proba(x) if s["classes"] else m.predict(x)[:, None] for m in s["models"]]
        return np.concatenate(parts + ([x] if self.passthrough else []), axis=1)

    def _predict(self, x, s):
        t = self.meta_features(x, s)
        return s["meta"].predict_proba(t) if s["classes"] else s["meta"].predict(t)


for _class in (Voting, Bagged, Stacking):
    register(f"lathe.{_class.family}@1", _class.restore)


@dataclass
class AutoFit:
    model: Estimator
    search: Search
    best: dict
    members: list[tuple[str, dict]]
    weights: list[float]
    preprocessor: Preprocessor | None = None

    def predict(self, df: DataFrame, row_id: str, features: list[str], out: str = "prediction") -> DataFrame:
        """(row_id, prediction) of a frame of the original features, scored in Arrow batches."""
        model, names = self.model, features
        if self.preprocessor is not None:
            df, names = self.preprocessor.transform(df.select(row_id, *features)), self.preprocessor.output_columns

        @F.arrow_udf("double")
        def run(rows: pa.Array) -> pa.Array:
            x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), len(names))
            return pa.array(np.asarray(model.predict(x), dtype=float))

        return df.select(row_id, run(F.array(*[F.col(f"`{c}`").cast("double") for c in names])).alias(out))


def auto_fit(spark, df: DataFrame, row_id: str, features: list[str], y: str, models: list[str], strategy: str = "random", cv: int = 5, seed: int = 42, n_iter: int = 20, ensemble: bool = True, ensemble_size: int = 20, disagreement: float = 0.05, refine: bool = True, meta: tuple[str, dict] | None = None, scoring: str | None = None, timeout: float | None = None, on_progress=None, preprocessor: Preprocessor | None = None) -> AutoFit:
    """Search, then the best model refitted on all rows, or an ensemble of the families' best.

    The pool is each family's best, then seconds; members too like those before them are left out;
    greedy selection gives weights, refined on the simplex. With three families and a meta-model the
    ensemble is a stack with the features passed through. A preprocessor is fitted on all rows first and
    is part of the result.
    """
    if preprocessor is not None:
        ready = preprocessor.fit(df).transform(df.select(row_id, *features, y))
        out = auto_fit(spark, ready, row_id, preprocessor.output_columns, y, models, strategy, cv, seed, n_iter, ensemble, ensemble_size, disagreement, refine, meta, scoring, timeout, on_progress)
        out.preprocessor = preprocessor
        return out
    data = Matrix.gather(df, row_id, features, y, cv, seed)
    search = run_search(spark, data, models, strategy, n_iter, seed, scoring=scoring, timeout=timeout, on_progress=on_progress)
    best = search.best()
    board = [r for r in search.board() if r["mean"] > float("-inf") and r["fraction"] in (1.0, best["fraction"])]
    firsts, seconds, seen = [], [], {}
    for r in board:
        seen[r["model"]] = seen.get(r["model"], 0) + 1
        if seen[r["model"]] <= 2:
            (firsts if seen[r["model"]] == 1 else seconds).append((r["model"], r["params"]))
    pool = (firsts + seconds)[: 2 * ensemble_size]
    if not ensemble or len(pool) < 2:
        model = create(best["model"], data.task, **best["params"]).fit(data.x, data.y)
        return AutoFit(model, search, best, [(best["model"], best["params"])], [1.0])
    oof = out_of_fold(spark, data, pool, seed)
    if on_progress:
        on_progress({"phase": "ensemble", "pool": len(pool)})
    y_at = np.unique(data.y, return_inverse=True)[1] if data.task == "classification" else data.y
    names = [str(i) for i in range(len(pool))]
    apart = {}
    for i in range(len(pool)):
        for j in range(i):
            if data.task == "classification":
                v = float((oof[i].argmax(1) != oof[j].argmax(1)).mean())
            else:
                spread = oof[i].std() * oof[j].std()
                v = 1.0 if spread < 1e-12 else 1 - abs(float(np.mean((oof[i] - oof[i].mean()) * (oof[j] - oof[j].mean())) / spread))
            apart[frozenset((names[i], names[j]))] = v
    kept = [int(i) for i in en.diversity_filter(names, apart, disagreement)]
    specs, oof = [pool[i] for i in kept], [oof[i] for i in kept]
    if meta and len({m for m, _ in specs}) >= 3:
        model = Stacking(specs, meta, cv, True, seed, data.task).fit(data.x, data.y)
        return AutoFit(model, search, best, specs, [1 / len(specs)] * len(specs))
    members, weights, _ = en.greedy_selection(oof, y_at, data.task, ensemble_size)
    if refine and len(members) > 1:
        weights = en.optimise_weights([oof[i] for i in members], y_at, weights, data.task).tolist()
    model = Voting([specs[i] for i in members], weights, task=data.task).fit(data.x, data.y)
    return AutoFit(model, search, best, [specs[i] for i in members], weights)
