"""Smoothing, decomposition, interpolation and forecasts of series stored as rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakewright.operators.windows import affine_scan, numbered, shifted


def exponential_smoothing(df: DataFrame, keys: list[str], order: list[str], value: str, alpha: float = 0.3,
                          name: str = "smoothed", chunks: int | None = None) -> DataFrame:
    """s[1] = x[1], s[n] = alpha * x[n] + (1 - alpha) * s[n-1] per series, for series of any length."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha must be above 0 and at most 1")
    placed = numbered(df, keys, order, "_seq", chunks)
    push = F.when(F.col("_seq") == 1, F.col(value)).otherwise(F.col(value) * alpha).cast("double")
    return affine_scan(placed.withColumn("_push", push), keys, "_seq", "_push", 1.0 - alpha, name).drop("_seq", "_push")


def decompose(df: DataFrame, keys: list[str], order: str, value: str, period: int) -> DataFrame:
    """Trend, seasonal and residual parts of evenly spaced, already aggregated series.

    Trend is the average of the last full period, the seasonal part the mean
    distance from it per phase. A series must be small, one row per time step.
    """
    by_time = Window.partitionBy(*keys).orderBy(order)
    full = by_time.rowsBetween(1 - period, 0)
    trended = (df.withColumn("_i", F.row_number().over(by_time) - 1)
               .withColumn("trend", F.when(F.count(value).over(full) == period, F.sum(value).over(full) / period))
               .withColumn("_phase", F.col("_i") % period))
    gap = F.col(value) - F.col("trend")
    return (trended.withColumn("seasonal", F.avg(gap).over(Window.partitionBy(*keys, "_phase")))
            .withColumn("residual", gap - F.col("seasonal")).drop("_i", "_phase"))


def interpolate(samples: DataFrame, points: DataFrame, keys: list[str], ts: str, tie: str, value: str,
                chunks: int | None = None) -> DataFrame:
    """Linear interpolation of the samples at the times of ``points`` (keys, ts).

    Outside the sampled span the nearest sample is kept.
    """
    pt = F.struct(F.col(ts).alias("at"), F.col(value).alias("v"))
    rows = samples.where(F.col(value).isNotNull()).select(*keys, ts, F.col(tie).alias("_tie"), F.lit(0).alias("_ask"), pt.alias("_pt"))
    asked = points.select(*keys, ts, F.lit(None).cast(rows.schema["_tie"].dataType).alias("_tie"), F.lit(1).alias("_ask"),
                          F.lit(None).cast(rows.schema["_pt"].dataType).alias("_pt"))
    both = rows.unionByName(asked)
    order = [ts, "_ask", "_tie"]
    near = shifted(both, keys, order, "_pt", 1, "_before", ignore_nulls=True, chunks=chunks)
    near = shifted(near, keys, order, "_pt", -1, "_after", ignore_nulls=True, chunks=chunks).where("_ask = 1")

    def micros(c):
        return F.unix_micros(F.col(c).cast("timestamp"))

    share = (micros(ts) - micros("_before.at")) / F.nullif(micros("_after.at") - micros("_before.at"), F.lit(0))
    line = F.col("_before.v") + (F.col("_after.v") - F.col("_before.v")) * share
    return near.select(*keys, ts, F.coalesce(line, F.col("_before.v"), F.col("_after.v")).alias("value"))


def predict_linear(df: DataFrame, keys: list[str], seconds: str, value: str, horizons: dict[str, float],
                   limit: float) -> DataFrame:
    """Line through each group's samples, read ``horizons`` seconds after time 0, against a limit.

    ``seconds`` is the sample time relative to the moment of evaluation.
    """
    fit = df.groupBy(*keys).agg(F.regr_slope(value, seconds).alias("_a"), F.regr_intercept(value, seconds).alias("_b"))
    at = {name: F.col("_b") + F.col("_a") * float(h) for name, h in horizons.items()}
    return fit.select(*keys, *[e.alias(n) for n, e in at.items()],
                      *[F.coalesce(e > limit, F.lit(False)).alias(f"{n}_alert") for n, e in at.items()])


FORECAST_SCHEMA = ("step int, point_forecast double, lower_80 double, upper_80 double, lower_95 double, "
                   "upper_95 double, mape double, mae double, rmse double")
# Normal quantiles of the 80 and 95 percent bands.
Z_80, Z_95 = 1.2815515655446004, 1.959963984540054


def _forecast(values: np.ndarray, max_horizon: int) -> pd.DataFrame:
    """Linear trend plus a first-order autoregression of what the trend leaves."""
    n = len(values)
    horizon = min(math.ceil(n * 0.3), max_horizon)
    x = np.arange(n, dtype=float)
    slope, base = np.polyfit(x, values, 1) if n >= 3 else (0.0, float(values.mean()))
    rest = values - (base + slope * x)
    denom = float((rest[:-1] ** 2).sum()) if n > 1 else 0.0
    phi = float(np.clip((rest[1:] * rest[:-1]).sum() / denom, -0.99, 0.99)) if denom > 0 else 0.0
    fitted = base + slope * x
    fitted[1:] += phi * rest[:-1]
    errors = values - fitted
    rmse = float(np.sqrt((errors ** 2).mean()))
    nonzero = values != 0
    mape = float(np.abs(errors[nonzero] / values[nonzero]).mean() * 100) if nonzero.any() else None
    steps = np.arange(1, horizon + 1)
    point = base + slope * (n - 1 + steps) + rest[-1] * phi ** steps
    spread = rmse * np.sqrt(np.cumsum(phi ** (2 * (steps - 1))))
    return pd.DataFrame({
        "step": steps.astype("int32"), "point_forecast": point,
        "lower_80": point - Z_80 * spread, "upper_80": point + Z_80 * spread,
        "lower_95": point - Z_95 * spread, "upper_95": point + Z_95 * spread,
        "mape": mape, "mae": float(np.abs(errors).mean()), "rmse": rmse})


def forecast(df: DataFrame, keys: list[str], order: str, value: str, max_horizon: int = 12) -> DataFrame:
    """Forecast with 80 and 95 percent bounds and accuracy, one model per already aggregated series."""
    types = dict(df.dtypes)
    head = "".join(f"`{k}` {types[k]}, " for k in keys)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = _forecast(pdf.sort_values(order)[value].to_numpy(dtype=float), max_horizon)
        for i, k in enumerate(keys):
            out.insert(i, k, pdf[k].iloc[0])
        return out

    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(one, head + FORECAST_SCHEMA)
