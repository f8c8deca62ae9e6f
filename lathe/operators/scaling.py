"""Scalers and the preprocessor: one aggregation to fit, one projection to transform."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lathe.errors import NotFittedError, ValidationError


def _number(x) -> float | None:
    return None if x is None else float(x)


class Scaler:
    """Common parts of the scalers."""

    kind = ""

    def __init__(self, features: Sequence[str]):
        self.features, self.state = list(features), None

    @property
    def is_fitted(self) -> bool:
        return self.state is not None

    def get_params(self) -> dict:
        return {"features": list(self.features)}

    def set_params(self, params: dict) -> Scaler:
        """Replaces the parameters; the scaler is to be fitted again."""
        if unknown := sorted(set(params) - {"features"}):
            raise ValidationError(f"a scaler has no parameters {', '.join(unknown)}")
        self.features, self.state = list(params.get("features", self.features)), None
        return self

    def dispose(self) -> None:
        self.state = None

    def fit(self, df: DataFrame) -> Scaler:
        row = df.agg(F.count(F.lit(1)).alias("n"), *self._statistics()).first()
        if not row["n"]:
            raise ValidationError("a scaler can't be fitted on no rows")
        self.state = {c: [_number(row[f"a_{c}"]), _number(row[f"b_{c}"])] for c in self.features}
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def transform(self, df: DataFrame) -> DataFrame:
        if self.state is None:
            raise NotFittedError
        if missing := [c for c in self.features if c not in df.columns]:
            raise ValidationError(f"no columns {missing}")
        return df.withColumns({c: self._scaled(F.col(c).cast("double"), *self.state[c]) for c in self.features})

    def get_state(self) -> dict:
        return {"kind": self.kind, "features": self.features, "state": self.state}

    @staticmethod
    def from_state(state: dict) -> Scaler:
        made = {"standard": StandardScaler, "minmax": MinMaxScaler}[state["kind"]](state["features"])
        made.state = state["state"]
        return made


class StandardScaler(Scaler):
    """(x - mean) / sample standard deviation; 0 where that is 0 or of one row."""

    kind = "standard"

    def _statistics(self) -> list[Column]:
        return [x for c in self.features for x in (F.avg(c).alias(f"a_{c}"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"b_{c}"))]

    def _scaled(self, x: Column, mean, std) -> Column:
        return F.when(x.isNotNull(), (x - mean) / std if std else F.lit(0.0))


class MinMaxScaler(Scaler):
    """(x - min) / (max - min), not clipped; 0 where all values are equal."""

    kind = "minmax"

    def _statistics(self) -> list[Column]:
        return [x for c in self.features for x in (F.min(c).cast("double").alias(f"a_{c}"), F.max(c).cast("double").alias(f"b_{c}"))]

    def _scaled(self, x: Column, low, high) -> Column:
        return F.when(x.isNotNull(), (x - low) / (high - low) if low is not None and high != low else F.lit(0.0))


@dataclass
class ColumnPlan:
    """What is done to one source column."""

    name: str
    categorical: bool
    fill: float | None = None
    values: list[float] = field(default_factory=list)
    shift: float = 0.0
    scale: float = 1.0


@dataclass
class Preprocessor:
    """Impute, encode and scale.

    encode: auto or onehot (a 0/1 column for each sorted value), label (its place, -1 if unseen) or
    False. impute: auto (mean, or mode with the smaller value of ties), median, zero or False. scale:
    standard (population deviation), minmax or None; numeric columns only, from the values present.
    A column is categorical if its values are whole and of 2 to max_categories kinds.
    """

    features: list[str]
    encode: str | bool = "auto"
    impute: str | bool = "auto"
    scale: str | None = None
    max_categories: int = 20
    plans: list[ColumnPlan] | None = None

    def __post_init__(self):
        if self.encode not in ("auto", "onehot", "label", False):
            raise ValidationError(f"unknown encode {self.encode!r}")
        if self.impute not in ("auto", "median", "zero", False):
            raise ValidationError(f"unknown impute {self.impute!r}")
        if self.scale not in ("standard", "minmax", None):
            raise ValidationError(f"unknown scale {self.scale!r}")

    def fit(self, df: DataFrame) -> Preprocessor:
        stats = []
        for c in self.features:
            x = F.col(c).cast("double")
            stats += [
                F.max((x != F.floor(x)).cast("int")).alias(f"broken_{c}"), F.count_distinct(x).alias(f"kinds_{c}"), F.avg(x).alias(f"mean_{c}"),
                F.stddev_pop(x).alias(f"std_{c}"), F.min(x).alias(f"min_{c}"), F.max(x).alias(f"max_{c}"), F.mode(x, True).alias(f"mode_{c}"),
            ]
            if self.impute == "median":
                stats.append(F.percentile(x, 0.5).alias(f"median_{c}"))
        row = df.agg(F.count(F.lit(1)).alias("n"), *stats).first()
        if not row["n"]:
            raise ValidationError("a preprocessor can't be fitted on no rows")
        self.plans = []
        for c in self.features:
            categorical = self.encode is not False and row[f"broken_{c}"] == 0 and 2 <= row[f"kinds_{c}"] <= self.max_categories
            plan = ColumnPlan(c, categorical)
            if self.impute == "zero":
                plan.fill = 0.0
            elif self.impute:
                plan.fill = _number(row[f"mode_{c}"] if categorical else row[f"median_{c}"] if self.impute == "median" else row[f"mean_{c}"])
            if not categorical and self.scale:
                spread = row[f"std_{c}"] if self.scale == "standard" else (row[f"max_{c}"] or 0.0) - (row[f"min_{c}"] or 0.0)
                plan.shift = _number(row[f"mean_{c}"] if self.scale == "standard" else row[f"min_{c}"]) or 0.0
                plan.scale = float(spread) if spread else 1.0
            self.plans.append(plan)
        names = [p.name for p in self.plans if p.categorical]
        if names:  # at most max_categories values of each
            sets = df.agg(*[F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in names]).first()
            for p in self.plans:
                if p.categorical:
                    p.values = [float(v) for v in sets[p.name]]
        return self

    def columns(self) -> dict[str, Column]:
        if self.plans is None:
            raise NotFittedError
        out: dict[str, Column] = {}
        for p in self.plans:
            x = F.col(p.name).cast("double")
            x = F.coalesce(x, F.lit(p.fill)) if p.fill is not None else x
            if not p.categorical:
                out[p.name] = (x - p.shift) / p.scale if self.scale else x
            elif self.encode == "label":
                code = F.when(x.isNull(), F.lit(-1))
                for i, v in enumerate(p.values):
                    code = code.when(x == v, i)
                out[p.name] = code.otherwise(-1).cast("double")
            else:
                for v in p.values:
                    out[f"{p.name}_{v:g}"] = F.when(x == v, 1.0).otherwise(0.0)
        return out

    @property
    def output_columns(self) -> list[str]:
        return list(self.columns())

    def transform(self, df: DataFrame) -> DataFrame:
        """Other columns stay; the features give way to the output columns."""
        made = self.columns()
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.features]
        return df.select(*kept, *[v.alias(k) for k, v in made.items()])

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def get_state(self) -> dict:
        return {"features": self.features, "encode": self.encode, "impute": self.impute, "scale": self.scale, "max_categories": self.max_categories, "plans": [asdict(p) for p in self.plans] if self.plans else None}

    @classmethod
    def from_state(cls, state: dict) -> Preprocessor:
        made = cls(**{k: v for k, v in state.items() if k != "plans"})
        made.plans = [ColumnPlan(**p) for p in state["plans"]] if state["plans"] is not None else None
        return made


def column_types(df: DataFrame, features: Sequence[str], max_categories: int = 20) -> DataFrame:
    """(feature, n_distinct, kind) of each column, from one aggregation."""
    row = df.agg(*[x for c in features for x in (F.max((F.col(c).cast("double") != F.floor(F.col(c).cast("double"))).cast("int")).alias(f"b_{c}"), F.count_distinct(F.col(c).cast("double")).alias(f"k_{c}"))])
    each = [F.struct(F.lit(c).alias("feature"), F.col(f"k_{c}").cast("long").alias("n_distinct"), F.when((F.col(f"b_{c}") == 0) & F.col(f"k_{c}").between(2, max_categories), "categorical").otherwise("numeric").alias("kind")) for c in features]
    return row.select(F.explode(F.array(*each)).alias("x")).select("x.*")


def quantile_thresholds(df: DataFrame, feature: str, n: int) -> list[float]:
    """Distinct inner quantiles at n even steps, at most one fewer than there are distinct values."""
    kinds = df.agg(F.count_distinct(feature).alias("k")).first()["k"]
    n = max(0, min(n, kinds - 1))
    if not n:
        return []
    at = [i / (n + 1) for i in range(1, n + 1)]
    values = df.agg(F.percentile(F.col(feature).cast("double"), F.array(*[F.lit(a) for a in at])).alias("q")).first()["q"]
    return sorted({float(v) for v in values if v is not None and not math.isnan(v)})
