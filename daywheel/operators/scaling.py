"""Scalers as one-row model tables, fitted on the train rows and broadcast to all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import RAIN

DISABLED = ("", "none", "null")


def scaler_kind(name: str | None) -> str | None:
    """"standard", "minmax" or None (off)."""
    kind = (name or "").strip().lower()
    if kind in DISABLED:
        return None
    if kind not in ("standard", "minmax"):
        raise ValueError(f"unknown scaler {name!r}")
    return kind


def _models(columns: list[str], kind: str) -> list[Column]:
    """Aggregates <column>_shift and <column>_scale; a scale of 0 becomes 1. Deviations are of the population."""
    found = []
    for c in columns:
        shift, scale = (F.avg(c), F.stddev_pop(c)) if kind == "standard" else (F.min(c), F.max(c) - F.min(c))
        found += [shift.alias(f"{c}_shift"), F.when(scale == 0, 1.0).otherwise(scale).alias(f"{c}_scale")]
    return found


def fit(rows: DataFrame, columns: list[str], kind: str) -> DataFrame:
    """One row: <column>_shift and <column>_scale."""
    return rows.agg(*_models(columns, kind))


def apply(df: DataFrame, model: DataFrame, columns: list[str]) -> DataFrame:
    """df with the columns scaled. model is one row."""
    names = [f"{c}_{x}" for c in columns for x in ("shift", "scale")]
    rows = df.crossJoin(F.broadcast(model.select(*names)))
    return rows.withColumns({c: (F.col(c) - F.col(f"{c}_shift")) / F.col(f"{c}_scale") for c in columns}).drop(*names)


def scale_split(df: DataFrame, columns: list[str], covariates: str | None = "standard", rain_scaler: str | None = None, rain: str = RAIN) -> DataFrame:
    """Covariates and rain scaled apart, by what the train rows say; None leaves its columns as they are."""
    parts = [(scaler_kind(covariates), [c for c in columns if c != rain]), (scaler_kind(rain_scaler), [c for c in columns if c == rain])]
    parts = [(kind, own) for kind, own in parts if kind and own]
    if not parts:
        return df
    # Both scalers come from one pass over the train rows.
    model = df.where("split = 'train'").agg(*[c for kind, own in parts for c in _models(own, kind)])
    return apply(df, model, [c for _, own in parts for c in own])


def fit_targets(samples: DataFrame, kind: str, column: str = "y_by_lead") -> DataFrame:
    """One scaler over all lead days of the train samples."""
    flat = samples.where("split = 'train'").select(F.explode(column).alias("y"))
    return fit(flat, ["y"], kind)


def scale_targets(samples: DataFrame, model: DataFrame, column: str = "y_by_lead", inverse: bool = False) -> DataFrame:
    rows = samples.crossJoin(F.broadcast(model))
    shift, scale = F.col("y_shift"), F.col("y_scale")
    step: Column = F.transform(column, (lambda y: y * scale + shift) if inverse else (lambda y: (y - shift) / scale))
    return rows.withColumn(column, step).drop("y_shift", "y_scale")
