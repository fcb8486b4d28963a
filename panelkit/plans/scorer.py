"""Scorers: what turns a batch of rows into predictions, the same in batch and in a stream.

A scorer is a callable ``DataFrame -> DataFrame`` that adds ``prediction`` and
``status`` and keeps every row: a row that cannot be scored has no prediction and a
status that says why.  ``LinearScorer`` is bound to a model fitted before (standard
scaler, linear model, signal) and is JVM expressions only; ``python_scorer``
wraps any function on pandas batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelkit.operators import linear as LI
from panelkit.operators import score as S

Scorer = Callable[[DataFrame], DataFrame]
OUT = [T.StructField("prediction", T.DoubleType()), T.StructField("status", T.StringType())]


@dataclass(frozen=True)
class LinearScorer:
    """Scaled features, linear prediction, signal (M2 -> M10 -> S1)."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    coef: tuple[float, ...]
    intercept: float
    multiplier: float = S.SIGNAL_MULTIPLIER

    @classmethod
    def fit(cls, train: DataFrame, features: Sequence[str], label: str, alpha: float = 0.0,
            multiplier: float = S.SIGNAL_MULTIPLIER) -> "LinearScorer":
        """Fit scaler and model on the complete rows of ``train``."""
        rows = train.select(*[F.col(c).cast("double").alias(c) for c in (*features, label)]).dropna()
        stats = LI.scaler_fit(rows, features)
        one = stats.first()
        model = LI.fit(LI.scaler_apply(rows, stats, features), features, label, alpha=alpha).first()
        if model is None:
            raise ValueError("no complete row to fit on")
        return cls(tuple(features), tuple(one[f"{c}__mean"] for c in features),
                   tuple(one[f"{c}__std"] or 1.0 for c in features), tuple(model["coef"]), model["intercept"], multiplier)

    def __call__(self, rows: DataFrame) -> DataFrame:
        pred, whole = F.lit(self.intercept), F.lit(True)
        for c, m, s, w in zip(self.features, self.mean, self.scale, self.coef):
            x = F.col(c).cast("double")
            whole = whole & x.isNotNull() & (F.abs(x) < float("inf"))
            pred = pred + (x - m) / s * w
        ok = F.coalesce(whole, F.lit(False))
        return rows.withColumns({"prediction": F.when(ok, S.ret_to_signal(pred, self.multiplier)),
                                 "status": F.when(ok, "ok").otherwise("missing_features")})


def python_scorer(score: Callable[[pd.DataFrame], pd.Series], features: Sequence[str]) -> Scorer:
    """A scorer from a function on pandas batches of ``features``.  It sees complete rows only; a
    prediction that is not finite is flagged ``invalid_prediction``."""
    features = list(features)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = b[features].apply(pd.to_numeric, errors="coerce").astype(float)
            ok = (x.notna() & (x.abs() != float("inf"))).all(axis=1)
            p = pd.Series(float("nan"), index=b.index)
            if ok.any():
                p[ok] = pd.Series(score(x[ok]), index=x.index[ok]).astype(float)
            good = p.notna() & (p.abs() != float("inf"))
            status = pd.Series("ok", index=b.index).mask(~good, "invalid_prediction").mask(~ok, "missing_features")
            yield b.assign(prediction=p.where(good), status=status)

    def run(rows: DataFrame) -> DataFrame:
        return rows.mapInPandas(scored, T.StructType([*rows.schema.fields, *OUT]))
    return run
