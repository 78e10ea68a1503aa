"""Training flows: fit and report, tune and refit, register."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloop.functions.vocabulary import NON_FEATURES, REAL
from scoreloop.operators.forest import fit_forest, fit_whole, search, split_metrics
from scoreloop.operators.project import column_roles
from scoreloop.operators.quality import drop_missing
from scoreloop.operators.split import contiguous_folds, hash_folds, split_bucket, split_exact
from scoreloop.sources.registry import ModelRegistry, save_with_copy, write_report


def train(
    df: DataFrame, target: str, key: str, excluded: Iterable[str] = (), test_size: float = 0.2, seed: int = 42,
    exact: bool = False, trees: int = 500, **forest_args,
) -> tuple[PipelineModel, dict]:
    """Split, fit on the training rows, score both splits in one pass.

    Returns the fitted model and the training report (without paths).
    """
    if target not in df.columns:
        raise ValueError(f"target {target!r} is not a column; available: {df.columns}")
    numeric, categorical = column_roles(df, {target, key, *excluded})
    splitter = split_exact if exact else split_bucket
    parted = splitter(df, key, test_size, seed)
    model = fit_forest(
        parted.filter("split = 'train'"), target, numeric, categorical, trees=trees, seed=seed, **forest_args
    )
    metrics = {
        r["split"]: {"n": r["n"], "mae": r["mae"], "rmse": r["rmse"], "r2": r["r2"]}
        for r in split_metrics(model.transform(parted), target).collect()  # two rows
    }
    report = {
        "timestamp": datetime.now().isoformat(timespec="seconds"),
        "engine_version": df.sparkSession.version,
        "random_state": seed,
        "test_size": test_size,
        "target": target,
        "n_rows": sum(m["n"] for m in metrics.values()),
        "n_features_before": len(numeric) + len(categorical),
        "num_cols": numeric,
        "cat_cols": categorical,
        "metrics": metrics,
    }
    return model, report


def train_and_report(df: DataFrame, target: str, key: str, model_root: str, report_path: str, name: str = "forest", **kwargs) -> dict:
    """``train``, then save the model (main and dated copy) and the report."""
    model, report = train(df, target, key, **kwargs)
    main, backup = save_with_copy(model, model_root, name)
    report["model_paths"] = {"main": main, "backup": backup}
    write_report(df.sparkSession, report_path, report)
    return report


def tune(
    df: DataFrame, target: str, key: str, excluded: Iterable[str] = (), folds: int = 3, contiguous: bool = False,
    trials: list[dict] | None = None, model_root: str | None = None, seed: int = 42, parallelism: int = 1, **fit_args,
) -> tuple[DataFrame, dict, PipelineModel]:
    """Search by k-fold mean R2, refit the best on a training split, save it; every fit is on all its rows.

    ``fit_args`` (category limit, defaults of the trials) hold for both.
    """
    numeric, categorical = column_roles(df, {target, key, *excluded})
    folded = contiguous_folds(df, key, folds) if contiguous else hash_folds(df, key, folds, seed)
    table, best = search(folded, target, numeric, categorical, trials=trials, k=folds, seed=seed, parallelism=parallelism, **fit_args)
    fit_rows = split_bucket(df, key, seed=seed).filter("split = 'train'")
    model = fit_whole(fit_rows, target, numeric, categorical, seed=seed, **{**fit_args, **best})
    if model_root:
        save_with_copy(model, model_root, "forest_tuned")
    return table, best, model


def train_or_register(
    df: DataFrame, registry: ModelRegistry, name: str, key: str, fallback: PipelineModel | None = None,
    target: str = REAL, excluded: Iterable[str] = (), trees: int = 400, **forest_args,
) -> int:
    """Train on the labelled rows and register; without labels register ``fallback``.

    The labelled path imputes medians and modes instead of scaling. An
    unlabelled table registers the given model with unknown (-1) metrics.
    """
    labelled = drop_missing(df, [target]) if target in df.columns else None
    if labelled is None or labelled.isEmpty():
        if fallback is None:
            raise ValueError("no labelled rows and no model to register")
        return registry.register(fallback, name, {})
    rows = labelled.withColumn(target, F.col(target).cast("double"))
    skip = {target, key, *(c for c in NON_FEATURES if c in rows.columns), *excluded}
    model, report = train(
        rows, target, key, excluded=skip, trees=trees, scale=False, impute_missing=True, **forest_args
    )
    test = report["metrics"].get("test", {})
    counts = {"n_train": report["metrics"].get("train", {}).get("n", 0), "n_test": test.get("n", 0)}
    return registry.register(model, name, {**test, **counts})
