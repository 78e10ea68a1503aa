"""Feature and error expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloop.functions.coerce import _col


def ratio_to_square(numerator: str | Column, base: str | Column) -> Column:
    """``numerator / base**2`` (weight over squared height); NULL for base 0."""
    base = _col(base).cast("double")
    return F.try_divide(_col(numerator).cast("double"), base * base)


def log_feature(c: str | Column, kind: str = "log1p") -> Column:
    """Natural log, ``kind`` "ln" or "log1p"; NULL outside the domain.

    Train and score must use the same kind, so the default is shared.
    """
    c = _col(c).cast("double")
    if kind == "ln":
        return F.ln(c)
    if kind == "log1p":
        return F.log1p(c)
    raise ValueError(f"unknown log kind: {kind!r}")


def round_half_even(c: str | Column, places: int) -> Column:
    """Scale, round to the even integer on ties, unscale."""
    scale = float(10**places)
    return F.rint(_col(c) * F.lit(scale)) / F.lit(scale)


def error_metrics(real: str | Column, pred: str | Column) -> dict[str, Column]:
    """Per-row errors: absolute and signed (3 places), relative in % (2 places)."""
    real, pred = _col(real), _col(pred)
    signed = real - pred
    return {
        "abs_error": round_half_even(F.abs(signed), 3),
        "signed_error": round_half_even(signed, 3),
        "relative_error": round_half_even(F.try_divide(F.abs(signed), real) * 100, 2),
    }
