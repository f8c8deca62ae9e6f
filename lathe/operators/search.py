"""Search spaces, candidate strategies and the rounds that a search runs in."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from lathe.errors import ValidationError
from lathe.functions.rng import MASK, lcg
from lathe.sources.bundle import stable_json


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def sample_param(spec: dict, u: float):
    """A parameter's value for a number from 0 to 1."""
    kind = spec["type"]
    if kind == "categorical":
        return spec["values"][min(int(u * len(spec["values"])), len(spec["values"]) - 1)]
    low, high = spec["low"], spec["high"]
    if kind == "uniform":
        return low + u * (high - low)
    if kind == "int_uniform":
        return min(low + int(u * (high - low + 1)), high)
    if kind in ("log_uniform", "int_log_uniform"):
        x = math.exp(math.log(low) + u * (math.log(high) - math.log(low)))
        return _half_up(x) if kind == "int_log_uniform" else x
    raise ValidationError(f"unknown parameter type {kind!r}")


def _applies(spec: dict, config: dict) -> bool:
    return all(config.get(k) == v for k, v in spec.get("condition", {}).items())


def sample_config(space: dict, draw: Callable[[], float]) -> dict:
    """Unconditional parameters first, then those whose condition holds."""
    config = {k: sample_param(s, draw()) for k, s in space.items() if "condition" not in s}
    for k, s in space.items():
        if "condition" in s and _applies(s, config):
            config[k] = sample_param(s, draw())
    return config


def random_configs(space: dict, n: int, seed: int = 42) -> list[dict]:
    draw = lcg(seed)
    return [sample_config(space, draw) for _ in range(n)]


def grid_values(spec: dict, steps: int) -> list:
    """A parameter's values at even steps; whole ranges of no more than that many are listed."""
    kind = spec["type"]
    if kind == "categorical":
        return list(spec["values"])
    low, high = spec["low"], spec["high"]
    if kind == "int_uniform" and high - low + 1 <= steps:
        return list(range(low, high + 1))
    at = [i / max(1, steps - 1) for i in range(steps)]
    if kind == "uniform":
        return [low + (high - low) * a for a in at]
    if kind == "int_uniform":
        return sorted({low + _half_up((high - low) * a) for a in at})
    logs = [math.exp(math.log(low) + (math.log(high) - math.log(low)) * a) for a in at]
    return sorted({_half_up(x) for x in logs}) if kind == "int_log_uniform" else logs


def grid_configs(space: dict, steps: int = 3) -> list[dict]:
    """All combinations; conditional parameters take their middle value where the condition holds."""
    free = {k: grid_values(s, steps) for k, s in space.items() if "condition" not in s}
    out = []
    for values in itertools.product(*free.values()):
        config = dict(zip(free, values, strict=True))
        for k, s in space.items():
            if "condition" in s and _applies(s, config):
                options = grid_values(s, steps)
                config[k] = options[len(options) // 2]
        out.append(config)
    return out


def candidate_id(model: str, params: dict) -> str:
    return f"{model}:{stable_json(params)}"


def random_candidates(spaces: dict[str, dict], n_iter: int = 20, seed: int = 42, fixed: dict[str, dict] | None = None) -> list[tuple[str, dict]]:
    """(model, params): n_iter of each model, each with a sequence seeded from the parent's."""
    parent, out = lcg(seed), []
    for model, space in spaces.items():
        held = (fixed or {}).get(model, {})
        open_ = {k: s for k, s in space.items() if k not in held}
        own = int(parent() * MASK)
        out += [(model, c | held) for c in random_configs(open_, n_iter, own)]
    return out


def halving_schedule(n: int, factor: int, cv: int, rows: int) -> list[dict]:
    """Rounds of successive halving: resources, candidates and survivors; the last round is on all rows."""
    rounds, reach = 0, 1
    while reach < n:
        rounds, reach = rounds + 1, reach * factor
    rounds = max(1, rounds)
    least = max(2 * cv, rows // factor**rounds)
    out, left = [], n
    for r in range(rounds):
        keep = max(1, -(-left // factor))
        out.append({"round": r, "resources": min(rows, least * factor**r), "candidates": left, "survivors": keep})
        left = keep
        if left <= 1:
            break
    return [*out, {"round": len(out), "resources": rows, "candidates": left, "survivors": left}]


#: Search spaces of the models. Fixed values.
SPACES: dict[str, dict] = {
    "linear": {
        "solver": {"type": "categorical", "values": [0, 6, 7]},
        "C": {"type": "log_uniform", "low": 1e-4, "high": 1e4},
        "eps": {"type": "log_uniform", "low": 1e-5, "high": 1e-1},
    },
    "svm": {
        "svmType": {"type": "categorical", "values": [0, 1]},
        "kernel": {"type": "categorical", "values": [2, 0, 1]},
        "C": {"type": "log_uniform", "low": 1e-3, "high": 1e3},
        "gamma": {"type": "log_uniform", "low": 1e-5, "high": 1e1},
        "degree": {"type": "int_uniform", "low": 2, "high": 5, "condition": {"kernel": 1}},
        "nu": {"type": "uniform", "low": 0.01, "high": 0.99, "condition": {"svmType": 1}},
    },
    "knn": {
        "k": {"type": "int_uniform", "low": 1, "high": 30},
        "metric": {"type": "categorical", "values": ["l2", "l1"]},
        "leafMaxSize": {"type": "int_uniform", "low": 5, "high": 50},
    },
    "boosting": {
        "max_depth": {"type": "int_uniform", "low": 3, "high": 10},
        "eta": {"type": "log_uniform", "low": 0.01, "high": 0.3},
        "numRound": {"type": "int_uniform", "low": 50, "high": 500},
        "subsample": {"type": "uniform", "low": 0.5, "high": 1.0},
        "colsample_bytree": {"type": "uniform", "low": 0.5, "high": 1.0},
        "min_child_weight": {"type": "log_uniform", "low": 1, "high": 10},
        "lambda": {"type": "log_uniform", "low": 1e-3, "high": 10},
        "alpha": {"type": "log_uniform", "low": 1e-3, "high": 10},
    },
    "leafwise": {
        "max_depth": {"type": "int_uniform", "low": 3, "high": 12},
        "learning_rate": {"type": "log_uniform", "low": 0.01, "high": 0.3},
        "numRound": {"type": "int_uniform", "low": 50, "high": 500},
        "subsample": {"type": "uniform", "low": 0.5, "high": 1.0},
        "colsample_bytree": {"type": "uniform", "low": 0.5, "high": 1.0},
        "min_child_weight": {"type": "log_uniform", "low": 1, "high": 10},
        "reg_lambda": {"type": "log_uniform", "low": 1e-3, "high": 10},
        "reg_alpha": {"type": "log_uniform", "low": 1e-3, "high": 10},
        "num_leaves": {"type": "int_uniform", "low": 15, "high": 127},
    },
    "forest": {
        "n_estimators": {"type": "int_uniform", "low": 50, "high": 500},
        "max_depth": {"type": "int_uniform", "low": 3, "high": 20},
        "max_features": {"type": "categorical", "values": ["sqrt", "log2", "third"]},
        "min_samples_split": {"type": "int_uniform", "low": 2, "high": 20},
        "min_samples_leaf": {"type": "int_uniform", "low": 1, "high": 10},
        "histogram_binning": {"type": "categorical", "values": [0, 1]},
    },
    "additive": {
        "learningRate": {"type": "log_uniform", "low": 0.001, "high": 0.1},
        "maxRounds": {"type": "int_uniform", "low": 1000, "high": 10000},
        "maxBins": {"type": "categorical", "values": [128, 256, 512]},
    },
    "mlp": {
        "hidden_sizes": {"type": "categorical", "values": [[64], [128], [64, 64], [128, 64]]},
        "activation": {"type": "categorical", "values": ["relu", "gelu", "silu"]},
        "lr": {"type": "log_uniform", "low": 1e-4, "high": 1e-1},
        "epochs": {"type": "int_uniform", "low": 10, "high": 200},
        "optimizer": {"type": "categorical", "values": ["adam", "sgd"]},
    },
    "fm": {
        "lr": {"type": "log_uniform", "low": 1e-4, "high": 1.0},
        "lambda": {"type": "log_uniform", "low": 1e-6, "high": 1e-1},
        "k": {"type": "int_uniform", "low": 2, "high": 16},
        "epoch": {"type": "int_uniform", "low": 5, "high": 50},
        "opt": {"type": "categorical", "values": ["adagrad", "sgd"]},
    },
    "bart": {
        "numTrees": {"type": "int_uniform", "low": 50, "high": 300},
        "numSamples": {"type": "int_uniform", "low": 20, "high": 200},
        "alpha": {"type": "uniform", "low": 0.5, "high": 0.99},
        "beta": {"type": "uniform", "low": 0.5, "high": 3.0},
        "minSamplesLeaf": {"type": "int_uniform", "low": 1, "high": 20},
    },
    "clauses": {
        "nClauses": {"type": "int_log_uniform", "low": 20, "high": 2000},
        "threshold": {"type": "int_uniform", "low": 10, "high": 200},
        "s": {"type": "log_uniform", "low": 1.0, "high": 20.0},
        "stateBits": {"type": "int_uniform", "low": 4, "high": 12},
        "boostTruePositiveFeedback": {"type": "categorical", "values": [True, False]},
        "nThresholdsPerFeature": {"type": "int_uniform", "low": 2, "high": 20},
        "nEpochs": {"type": "int_uniform", "low": 20, "high": 200},
    },
}

SPACES["ffm"] = {k: v for k, v in SPACES["fm"].items() if k != "opt"}
SPACES["tabm"] = SPACES["mlp"] | {"members": {"type": "categorical", "values": [4, 8, 16, 32]}}
SPACES["nam"] = SPACES["mlp"] | {"hidden_sizes": {"type": "categorical", "values": [[32], [64], [64, 32], [128]]}}

#: How many configurations a family has in the portfolio.
PORTFOLIO_SIZES = {"boosting": 10, "leafwise": 6, "additive": 4, "linear": 4, "svm": 4, "knn": 3, "clauses": 3, "forest": 7, "mlp": 4, "fm": 3}


def _radical_inverse(i: int, base: int) -> float:
    out, f = 0.0, 1.0
    while i:
        f /= base
        out += f * (i % base)
        i //= base
    return out


def portfolio(task: str = "classification") -> dict[str, list[dict]]:
    """Fixed configurations of each family: points of its space by a low-discrepancy rule.

    An unknown task counts as classification; an unknown family has one empty configuration.
    """
    primes = (2, 3, 5, 7, 11, 13, 17, 19, 23)
    out = {}
    for family, size in PORTFOLIO_SIZES.items():
        configs = []
        for i in range(1, size + 1):
            numbers = iter([_radical_inverse(i, p) for p in primes])
            configs.append(sample_config(SPACES[family], lambda n=numbers: next(n)))
        out[family] = configs
    return out


def portfolio_of(family: str, task: str = "classification") -> list[dict]:
    return portfolio(task).get(family, [{}])
