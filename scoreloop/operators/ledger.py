"""The prediction ledger: one row per prediction id, patched by feedback."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scoreloop.functions import (
    error_metrics,
    event_time,
    iso_utc,
    local_string,
    log_feature,
    normalise_email,
    parse_any_timestamp,
    parse_timestamp,
    ratio_to_square,
    to_double,
    user_id,
    with_parsed_number,
)
from scoreloop.functions.vocabulary import HISTORY_COLUMNS, PREDICTED, REAL
from scoreloop.operators.project import select_present
from scoreloop.operators.quality import LOOKUP_RULES, require_valid

PATCH_PRED = f"{PREDICTED}_feedback"
ERRORS = ("abs_error", "signed_error", "relative_error")
# Fields a patch sets always, and only when it brings a prediction.
LABEL_FIELDS = (REAL, "feedback_timestamp")
ERROR_FIELDS = (PATCH_PRED, *ERRORS)


def latest_per_key(df: DataFrame, keys: Iterable[str], order: Iterable[str | Column]) -> DataFrame:
    """Whole-row last write wins per key; missing key parts are a value too.

    ``max_by`` keeps one candidate per key and map task, so a key with a third
    of the writes shuffles one row per task. Where the order names columns that can be
    compared, the candidate itself is ordered, so that no value goes through the shuffle twice.
    """
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    named = {c for c in order if isinstance(c, str)}
    if len(named) == len(order) and named <= set(rest) and not any("map<" in df.schema[c].dataType.simpleString() or "variant" in df.schema[c].dataType.simpleString() for c in rest):
        best = F.max(F.struct(*[F.col(f"`{c}`") for c in [*order, *(c for c in rest if c not in named)]]))
    else:
        best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*[
        F.col(c) if c in keys else F.col(f"__r.`{c}`").alias(c) for c in df.columns
    ])


def route_feedback(feedback: DataFrame, key: str = "prediction_id") -> tuple[DataFrame, DataFrame]:
    """(rows that name a prediction, orphan rows with a missing or empty id)."""
    named = F.coalesce(F.col(key), F.lit("")) != ""
    return feedback.filter(named), feedback.filter(~named)


def patches_from_feedback(
    feedback: DataFrame, key: str = "prediction_id", timestamp: str = "timestamp",
    real: str = REAL, pred: str = PREDICTED,
) -> DataFrame:
    """Feedback rows that name a prediction, as ledger patches with errors."""
    linked, _ = route_feedback(feedback, key)
    y, p = to_double(real), to_double(pred)
    return linked.select(
        F.col(key), y.alias(REAL), F.col(timestamp).alias("feedback_timestamp"),
        p.alias(PATCH_PRED), *[m.alias(name) for name, m in error_metrics(y, p).items()],
    )


def fold_patches(patches: DataFrame, key: str = "prediction_id", order: Iterable[str] = ("feedback_timestamp",)) -> DataFrame:
    """Net effect of many patches per id, map-side combined.

    The label comes from the last patch; prediction and errors from the last
    patch that brought a prediction, so a later patch without one keeps them.
    ``label_order`` and ``error_order`` remember what each part came from, and
    let folded patches be folded again with newer or late ones. Patches of the
    same instant rank by their values, so arrival order never matters.
    """
    at = F.struct(*order, REAL, PATCH_PRED)
    if "label_order" in patches.columns:
        label_at, error_at = F.col("label_order"), F.col("error_order")
    else:
        label_at, error_at = at, at
    label = F.max_by(F.struct(*LABEL_FIELDS, label_at.alias("o")), label_at)
    error = F.max_by(
        F.struct(*ERROR_FIELDS, error_at.alias("o")), F.when(F.col(PATCH_PRED).isNotNull(), error_at)
    )
    return patches.groupBy(key).agg(label.alias("l"), error.alias("e")).select(
        key,
        *[F.col(f"l.{c}").alias(c) for c in LABEL_FIELDS],
        *[F.col(f"e.{c}").alias(c) for c in ERROR_FIELDS],
        F.col("l.o").alias("label_order"),
        F.col("e.o").alias("error_order"),
    )


def merge_patches(
    ledger: DataFrame, folded: DataFrame, key: str = "prediction_id", keep_order: bool = False
) -> DataFrame:
    """Upsert folded patches: patched fields replaced, the others kept.

    An unknown id makes a stub row. Both sides hold one row per id, so the
    join has neither fan-out nor skew. ``keep_order`` also carries the order
    columns of the patches.
    """
    label = [*LABEL_FIELDS, *(["label_order"] if keep_order else [])]
    error = [*ERROR_FIELDS, *(["error_order"] if keep_order else [])]
    patched = F.col(f"p.{key}").isNotNull()
    with_error = patched & F.col(f"p.{PATCH_PRED}").isNotNull()
    out: list[Column] = [F.coalesce(f"b.{key}", f"p.{key}").alias(key)]
    out += [F.col(f"b.`{c}`") for c in ledger.columns if c not in (key, *label, *error)]
    for fields, when in ((label, patched), (error, with_error)):
        for c in fields:
            old = F.col(f"b.{c}") if c in ledger.columns else F.lit(None)
            out.append(F.when(when, F.col(f"p.{c}")).otherwise(old).alias(c))
    same = F.col(f"b.{key}") == F.col(f"p.{key}")
    return ledger.alias("b").join(folded.alias("p"), same, "full_outer").select(*out)


# ---- reads ----------------------------------------------------------------

def history(df: DataFrame, email: str | None = None, ingested: str | None = None, tie: str = "prediction_id") -> DataFrame:
    """History rows with ISO time and parsed numbers, oldest first.

    Missing times sort first. Without ``email`` all users come back, each
    user's rows together; the sort ranges over (email, time), so one busy user
    spreads over many partitions.
    """
    if email is not None:
        df = df.filter(F.col("email") == normalise_email(F.lit(email)))
    ts = event_time("timestamp", ingested) if ingested else F.col("timestamp")
    out = df.withColumn("timestamp", iso_utc(ts))
    for name in (PREDICTED, REAL):
        if name in out.columns:
            out = with_parsed_number(out, name)
    order = [F.asc_nulls_first("timestamp"), F.asc(tie)]
    return out.orderBy(*([] if email is not None else [F.asc("email")]), *order)


def history_table(df: DataFrame, zone: str = "Europe/Madrid", tie: str = "prediction_id") -> DataFrame:
    """Display form: newest first, missing times last, local wall-clock text.

    ``timestamp`` may be text in any form ``parse_any_timestamp`` reads.
    """
    ts = parse_any_timestamp(F.col("timestamp").cast("string"))
    ordered = df.withColumn("__ts", ts).orderBy(F.desc_nulls_last("__ts"), F.asc(tie))
    return select_present(ordered.withColumn("timestamp", local_string("__ts", zone)), HISTORY_COLUMNS)


def latest_predictions(df: DataFrame, n: int = 10, tie: str = "prediction_id") -> DataFrame:
    """The n newest rows; rows without a time count as newest."""
    return df.orderBy(F.desc_nulls_first("timestamp"), F.desc(tie)).limit(n)


def training_rows(df: DataFrame) -> DataFrame:
    """Labelled rows with numeric label and prediction; no prediction is 0."""
    return df.withColumns({
        REAL: to_double(REAL), PREDICTED: F.coalesce(to_double(PREDICTED), F.lit(0.0))
    }).filter(F.col(REAL).isNotNull())


def lookup(df: DataFrame, email: str, key: str = "prediction_id") -> DataFrame:
    """Plain rows of one lower-cased email with the id as ``doc_id``; an email too short to be one is an error."""
    require_valid({"email": email}, LOOKUP_RULES)
    return df.filter(F.col("email") == F.lower(F.lit(email))).withColumn("doc_id", F.col(key))


def series_long(df: DataFrame, timestamp: str = "timestamp", names: dict[str, str] | None = None) -> DataFrame:
    """(timestamp, serie, value) for plotting; missing times and values dropped."""
    names = names or {PREDICTED: "Predicción", REAL: "Real"}
    present = {c: label for c, label in names.items() if c in df.columns}
    wide = df.select(timestamp, *[to_double(c).alias(label) for c, label in present.items()])
    return wide.unpivot([timestamp], list(present.values()), "serie", "value").dropna(
        subset=[timestamp, "value"]
    )


# ---- log -> table ---------------------------------------------------------

def sync_predictions(log: DataFrame) -> DataFrame:
    """Logged predictions in feature-group form, label still unknown."""
    return log.withColumns({
        "user_id": user_id("email"),
        "timestamp": parse_timestamp("timestamp"),
        "experience_level": F.col("experience_level").try_cast("int"),
        "workout_frequency_days_week": F.col("workout_frequency_days_week").try_cast("int"),
        REAL: F.lit(None).cast("double"),
        "bmi": ratio_to_square("weight_kg", "height_m"),
        "log_age": log_feature("age", "log1p"),
    })


def sync_feedback(log: DataFrame) -> DataFrame:
    """Logged feedback in feature-group form."""
    return log.withColumns({"user_id": user_id("email"), "timestamp": parse_timestamp("timestamp")})
