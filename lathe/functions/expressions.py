"""Scalar and vector expressions of the scorers, as Columns that stay in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(columns: Sequence[Column]) -> Column:
    out = F.lit(0.0)
    for c in columns:
        out = out + c
    return out


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def probit(z: Column) -> Column:
    """The standard normal distribution function, by a polynomial that is off by less than 7.5e-8."""
    # fixed values: Abramowitz and Stegun 26.2.17
    t = 1 / (1 + 0.2316419 * F.abs(z))
    poly = F.lit(0.0)
    for c in (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530):
        poly = t * (c + poly)
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z < 0, tail).otherwise(1 - tail)


def softmax(zs: Sequence[Column]) -> list[Column]:
    """Probabilities of a row's scores, shifted by their maximum."""
    top = F.greatest(*zs)
    e = [F.exp(z - top) for z in zs]
    return [x / total(e) for x in e]


def argmax(ps: Sequence[Column]) -> Column:
    """Index of the largest of a row's columns; the lowest index of equal ones."""
    arr = F.array(*ps)
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def bin_index(x: Column, cuts: Sequence[float]) -> Column:
    """How many cuts are at or below x; one past the last bin for a missing value."""
    inside = total([F.when(x >= float(c), 1.0).otherwise(0.0) for c in cuts]) if cuts else F.lit(0.0)
    return F.when(x.isNull(), F.lit(len(cuts) + 1)).otherwise(inside.cast("int"))


def pick(values: Sequence[float], at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), at + 1)


def linear(xs: Sequence[Column], weights: Sequence[float], bias: float = 0.0) -> Column:
    return F.lit(float(bias)) + total([x * float(w) for x, w in zip(xs, weights, strict=True)])


def factorisation(xs: Sequence[Column], weights: Sequence[float], bias: float, factors: Sequence[Sequence[float]], normalise: bool = True) -> Column:
    """Linear plus pairwise score, interactions by the sum-of-squares identity.

    With `normalise` the linear part is divided by a row's length and the pairs by its fourth power;
    a zero row stays.
    """
    norm = total([x * x for x in xs])
    inverse = F.when(norm == 0, F.lit(1.0)).otherwise(1 / norm) if normalise else F.lit(1.0)
    line = total([x * float(w) for x, w in zip(xs, weights, strict=True)]) * F.sqrt(inverse)
    cross = F.lit(0.0)
    for f in range(len(factors[0])):
        vx = [x * float(v[f]) for x, v in zip(xs, factors, strict=True)]
        s = total(vx)
        cross = cross + s * s - total([t * t for t in vx])
    return F.lit(float(bias)) + line + cross * inverse * inverse * 0.5


def field_aware(xs: Sequence[Column], fields: Sequence[int], weights: Sequence[float], bias: float, factors, normalise: bool = True) -> Column:
    """Linear score plus, for each pair, the product of each one's factors for the other's field."""
    norm = total([x * x for x in xs])
    inverse = F.when(norm == 0, F.lit(1.0)).otherwise(1 / norm) if normalise else F.lit(1.0)
    out = F.lit(float(bias)) + total([x * float(w) for x, w in zip(xs, weights, strict=True)]) * F.sqrt(inverse)
    for i in range(len(xs)):
        for j in range(i + 1, len(xs)):
            dot = sum(a * b for a, b in zip(factors[i][fields[j]], factors[j][fields[i]], strict=True))
            out = out + xs[i] * xs[j] * float(dot) * inverse * inverse
    return out


def tree(node, columns: dict[str, Column]) -> Column:
    """A decision tree: a number, or (column, threshold, at most, above)."""
    if isinstance(node, (int, float)):
        return F.lit(float(node))
    name, threshold, low, high = node
    return F.when(columns[name] <= float(threshold), tree(low, columns)).otherwise(tree(high, columns))


def forest_mean(trees, columns: dict[str, Column], scale: float = 1.0, shift: float = 0.0) -> Column:
    return total([tree(t, columns) for t in trees]) / float(len(trees)) * float(scale) + float(shift)


def literals(xs: Sequence[Column], thresholds: Sequence[Sequence[float]]) -> Column:
    """Bits of `x > t` for each threshold, then of their negations, as one whole number."""
    tests = [(x > float(t)) for x, ts in zip(xs, thresholds, strict=True) for t in ts]
    n = len(tests)
    out = F.lit(0).cast("long")
    for i, t in enumerate(tests):
        out = out + F.when(t, F.lit(1 << i)).otherwise(F.lit(1 << (n + i))).cast("long")
    return out


def clause_votes(bits: Column, includes: Sequence[int]) -> Column:
    """Votes of the first half of the clauses less those of the second; an empty clause is silent."""
    half = len(includes) // 2
    fired = lambda m: (bits.bitwiseAND(F.lit(m).cast("long")) == F.lit(m).cast("long")).cast("long") if m else F.lit(0).cast("long")
    out = F.lit(0).cast("long")
    for i, m in enumerate(includes):
        out = out + fired(m) if i < half else out - fired(m)
    return out


def dense(xs: Sequence[Column], weights: Sequence[Sequence[float]], biases: Sequence[float]) -> list[Column]:
    """A layer: a weighted sum of all inputs for each row of weights."""
    return [linear(xs, w, b) for w, b in zip(weights, biases, strict=True)]


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def silu(x: Column) -> Column:
    return x * sigmoid(x)


def gelu(x: Column) -> Column:
    """Gaussian error linear unit, by its tanh form."""
    return 0.5 * x * (1 + F.tanh(0.7978845608028654 * (x + 0.044715 * x * x * x)))
