"""Keys derived from an email address."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloop.functions.coerce import _col
from scoreloop.functions.timestamps import iso_utc, truncate_to_second


def normalise_email(email: str | Column) -> Column:
    """Strip surrounding white space of any kind, then lower-case."""
    return F.lower(F.btrim(_col(email), F.lit(" \t\n\r\f\v")))


def user_id(email: str | Column) -> Column:
    """Pseudonym: first 16 hex digits of SHA-256 of the lower-cased email."""
    return F.substring(F.sha2(F.lower(_col(email)), 256), 1, 16)


def prediction_id(email: str | Column, ts: str | Column) -> Column:
    """``name_domain__<ISO second>`` from an already normalised email."""
    local = F.replace(_col(email), F.lit("@"), F.lit("_"))
    return F.concat(local, F.lit("__"), iso_utc(truncate_to_second(ts)))
