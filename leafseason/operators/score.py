"""Scoring of normalised features with a pluggable classifier."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafseason.functions.arithmetic import null_to_sentinel
from leafseason.schema import FEATURES, NODATA
from leafseason.workers import ship

ship(__name__)


class Scorer(Protocol):
    """Gives the probability of the positive class for columns chosen by feature name."""

    def probability(self, features: Mapping[str, Column]) -> Column: ...


@dataclass(frozen=True)
class Logistic:
    """A logistic model as one column expression, evaluated inside generated code."""

    weights: Mapping[str, float]
    intercept: float

    def probability(self, features: Mapping[str, Column]) -> Column:
        z = F.lit(self.intercept)
        for name, w in self.weights.items():
            z = z + features[name] * float(w)
        return 1 / (1 + F.exp(-z))

    @classmethod
    def from_json(cls, text: str) -> Logistic:
        said = json.loads(text)
        return cls(said["weights"], said["intercept"])


@dataclass(frozen=True)
class ArrowModel:
    """Any model with predict_proba over a frame of named columns, run on Arrow batches.

    model must be picklable; columns are handed over by name, in the order of names.
    """

    model: object
    names: tuple[str, ...] = field(default=tuple(FEATURES.values()))

    def probability(self, features: Mapping[str, Column]) -> Column:
        model, names = self.model, self.names

        def predict(frame: pd.DataFrame) -> pd.Series:
            out = pd.Series(np.nan, index=frame.index, dtype="float64")
            whole = frame.notna().all(axis=1)
            if whole.any():
                out[whole] = np.asarray(model.predict_proba(frame.loc[whole, list(names)]))[:, 1]
            return out

        predict.__annotations__ = {"frame": pd.DataFrame, "return": pd.Series}
        made = F.pandas_udf(predict, "double")(F.struct(*(features[n].alias(n) for n in names)))
        return F.nanvl(made, F.lit(None).cast("double"))


@dataclass(frozen=True)
class LogisticModel:
    """The same logistic function behind predict_proba, for ArrowModel."""

    weights: Mapping[str, float]
    intercept: float

    def predict_proba(self, frame: pd.DataFrame) -> np.ndarray:
        z = sum((frame[n].to_numpy() * w for n, w in self.weights.items()), np.full(len(frame), self.intercept))
        p = 1 / (1 + np.exp(-z))
        return np.stack((1 - p, p), axis=1)


@dataclass(frozen=True)
class SparkModel:
    """A fitted pyspark.ml pipeline that reads the named feature columns and writes a probability vector."""

    path: str

    def apply(self, df: DataFrame) -> DataFrame:
        from pyspark.ml import PipelineModel
        from pyspark.ml.functions import vector_to_array

        return PipelineModel.load(self.path).transform(df).withColumn("proba", vector_to_array("probability")[1])


def feature_frame(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and the five features under the model's names, in its order."""
    return df.select(*keys, *(F.col(i).alias(f) for i, f in FEATURES.items()))


def complete(features: DataFrame) -> Column:
    """Whether all five features of a row are known."""
    return every([F.col(f).isNotNull() for f in FEATURES.values()])


def every(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def score(features: DataFrame, scorer: Scorer | SparkModel, mode: str = "proba", threshold: float = 0.5) -> DataFrame:
    """features with proba (NULL unless all are known), or with mode 'label' with label: 1 above threshold, else 0, NODATA if unknown."""
    if mode not in ("proba", "label"):
        raise ValueError("mode must be proba or label")
    if isinstance(scorer, SparkModel):
        # One pass: rows that aren't complete are scored as zeros, and their scores are dropped.
        names = {f: f"__{f}" for f in FEATURES.values()}
        filled = features.withColumn("__whole", complete(features)).withColumnsRenamed(names)
        filled = filled.withColumns({f: F.coalesce(F.col(o), F.lit(0.0)) for f, o in names.items()})
        scored = scorer.apply(filled).withColumn("proba", F.when(F.col("__whole"), F.col("proba")))
        done = scored.withColumns({f: F.col(o) for f, o in names.items()}).select(*features.columns, "proba")
    else:
        columns = {f: F.col(f) for f in FEATURES.values()}
        done = features.withColumn("proba", F.when(complete(features), scorer.probability(columns)))
    if mode == "proba":
        return done
    return done.withColumn("label", null_to_sentinel(F.when(F.col("proba") > threshold, 1).when(F.col("proba").isNotNull(), 0), NODATA).cast("int")).drop("proba")
