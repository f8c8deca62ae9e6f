"""Pipelines of frame transformers and a last model, saved as nested bundles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lathe.errors import NotFittedError, ValidationError
from lathe.operators.automl import MAX_CELLS
from lathe.operators.estimators import Estimator
from lathe.operators.scaling import Preprocessor, Scaler
from lathe.sources.bundle import decode_json, encode_bundle, encode_json
from lathe.sources.registry import load, register


def scaler_bytes(step: Scaler | Preprocessor) -> bytes:
    kind = "preprocessor" if isinstance(step, Preprocessor) else "scaler"
    return encode_bundle({"typeId": f"lathe.{kind}@1"}, [{"id": "state", "data": encode_json(step.get_state()), "mediaType": "application/json"}])


register("lathe.scaler@1", lambda m, t, b: Scaler.from_state(decode_json(b["state"])))
register("lathe.preprocessor@1", lambda m, t, b: Preprocessor.from_state(decode_json(b["state"])))


class Pipeline:
    """Named steps: transformers of frames, then an estimator of numeric columns (or a transformer)."""

    def __init__(self, steps: list[tuple[str, object]]):
        if not steps:
            raise ValidationError("a pipeline has one step at least")
        if len({n for n, _ in steps}) < len(steps):
            raise ValidationError("steps need names of their own")
        self.steps, self.fitted, self.features = list(steps), False, []

    def _features(self, df: DataFrame, not_features) -> list[str]:
        return [c for c in df.columns if c not in not_features]

    def fit(self, df: DataFrame, y: str, row_id: str, max_cells: int = MAX_CELLS) -> Pipeline:
        """A local estimator is fitted on the driver, on `max_cells` values at most; larger data raise an error."""
        for _, step in self.steps[:-1]:
            df = step.fit(df).transform(df)
        last = self.steps[-1][1]
        self.features = self._features(df, (y, row_id))
        if isinstance(last, Estimator):
            if df.count() * len(self.features) > max_cells:
                raise ValidationError(f"more than {max_cells} values; use lathe.operators.distributed")
            rows = df.select(*self.features, y).toPandas()
            last.fit(rows[self.features].to_numpy(float), rows[y].to_numpy())
        else:
            last.fit(df)
        self.fitted, self.y, self.row_id = True, y, row_id
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFittedError
        for _, step in self.steps[:-1] if isinstance(self.steps[-1][1], Estimator) else self.steps:
            df = step.transform(df)
        return df

    def predict(self, df: DataFrame, out: str = "prediction") -> DataFrame:
        """`df` (its id and the transformed columns) with predictions, scored in Arrow batches."""
        ready, model, names = self.transform(df), self.steps[-1][1], self.features
        if not isinstance(model, Estimator):
            raise ValidationError("the last step doesn't predict")

        @F.arrow_udf("double")
        def run(rows: pa.Array) -> pa.Array:
            x = rows.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), len(names))
            return pa.array(np.asarray(model.predict(x), dtype=float))

        return ready.withColumn(out, run(F.array(*[F.col(f"`{c}`").cast("double") for c in names])))

    def get_params(self) -> dict:
        return {n: s.get_params() if hasattr(s, "get_params") else s.get_state() for n, s in self.steps}

    def set_params(self, params: dict) -> Pipeline:
        for n, s in self.steps:
            if n in params:
                s.set_params(params[n])
        self.fitted = False
        return self

    def save(self) -> bytes:
        if not self.fitted:
            raise NotFittedError
        parts = [{"id": n, "data": s.save() if isinstance(s, Estimator) else scaler_bytes(s)} for n, s in self.steps]
        return encode_bundle({"typeId": "lathe.pipeline@1", "steps": [n for n, _ in self.steps], "features": self.features, "y": self.y, "rowId": self.row_id}, parts)


def _load(manifest, _toc, blobs) -> Pipeline:
    made = Pipeline([(n, load(blobs[n])) for n in manifest["steps"]])
    made.fitted, made.features, made.y, made.row_id = True, manifest["features"], manifest["y"], manifest["rowId"]
    return made


register("lathe.pipeline@1", _load)
