"""Chains of named steps over one table."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame

StepFn = Callable[..., DataFrame]
STEPS: dict[str, StepFn] = {}


def register_step(name: str, fn: StepFn) -> None:
    """Make ``fn(df, **args) -> DataFrame`` available as a step."""
    STEPS[name] = fn


def run_steps(df: DataFrame, spec: Sequence[Mapping]) -> tuple[DataFrame, DataFrame]:
    """Apply ``{type, …args}`` steps in order and stop at the first one that fails.

    Returns (table after the last good step, summary: step, type, status, message, columns_added, columns_removed).
    """
    rows = []
    for i, step in enumerate(spec):
        args = {k: v for k, v in step.items() if k != "type"}
        try:
            if step["type"] not in STEPS:
                raise ValueError(f"unknown step: {step['type']}")
            after = STEPS[step["type"]](df, **args)
        except Exception as err:  # noqa: BLE001  the summary reports it
            rows.append((i, step["type"], "error", str(err).split("\n")[0], [], []))
            break
        added = [c for c in after.columns if c not in df.columns]
        removed = [c for c in df.columns if c not in after.columns]
        rows.append((i, step["type"], "ok", None, added, removed))
        df = after
    schema = "step int, type string, status string, message string, columns_added array<string>, columns_removed array<string>"
    return df, df.sparkSession.createDataFrame(rows, schema)


def _defaults() -> None:
    from ..operators import missing, outliers, reshape, scaling, windows

    for module, names in (
        (reshape, ["filter_conditions", "select_columns", "collapse_categories"]),
        (missing, ["dropna", "impute_mean_median", "impute_mode_constant", "fill_forward_backward", "interpolate_time",
                   "impute_knn", "impute_regression"]),
        (scaling, ["scale_standard", "scale_minmax", "scale_robust", "encode_onehot", "encode_label", "encode_ordinal",
                   "bin_uniform", "bin_quantile", "bin_kmeans", "group_codes", "segments", "period_codes"]),
        (outliers, ["outlier_zscore", "outlier_iqr", "outlier_remove_rows", "outlier_replace", "outlier_isolation_forest", "outlier_dbscan"]),
        (windows, ["lag_features", "diff_features", "rolling_features", "time_features", "parse_datetime", "resample", "seasonal_decompose"]),
    ):
        for name in names:
            register_step(name, getattr(module, name))


_defaults()
