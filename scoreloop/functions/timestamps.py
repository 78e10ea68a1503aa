"""Timestamp parsing, rounding and rendering (session time zone UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scoreloop.functions.coerce import _col


def parse_timestamp(c: str | Column) -> Column:
    """ISO text (with or without offset) or a timestamp; anything else is NULL."""
    return _col(c).try_cast("timestamp")


def parse_any_timestamp(c: str | Column) -> Column:
    """Text holding ISO time or ``{"_seconds": n}`` / ``{"seconds": n}``.

    The first of the two keys that is present decides; when its value is not
    an integer the result is NULL, without trying the other key.
    """
    c = _col(c)
    keys = F.json_object_keys(c)
    doc = F.try_parse_json(c)

    def seconds(key: str) -> Column:
        return F.timestamp_seconds(F.try_variant_get(doc, f"$.{key}", "bigint"))

    return (
        F.when(F.array_contains(keys, "_seconds"), seconds("_seconds"))
        .when(F.array_contains(keys, "seconds"), seconds("seconds"))
        .when(keys.isNull(), c.try_cast("timestamp"))
    )


def round_to_second(ts: str | Column) -> Column:
    """Nearest second, ties to the even second."""
    micros = F.unix_micros(_col(ts).cast("timestamp"))
    return F.timestamp_micros(F.bround(micros, F.lit(-6)))


def truncate_to_second(ts: str | Column) -> Column:
    return F.date_trunc("second", _col(ts).cast("timestamp"))


def date_string(ts: str | Column) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd")


def iso_utc(ts: str | Column) -> Column:
    """ISO-8601 with ``+00:00``; the fraction is printed only when there is one."""
    ts = _col(ts).cast("timestamp")
    whole = F.date_trunc("second", ts) == ts
    return F.when(whole, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")).otherwise(
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")
    )


def local_string(ts: str | Column, zone: str = "Europe/Madrid") -> Column:
    """Wall-clock text in another zone, daylight saving included."""
    return F.date_format(F.from_utc_timestamp(_col(ts), zone), "yyyy-MM-dd HH:mm:ss")


def event_time(ts: str | Column, ingested: str | Column) -> Column:
    """Event time, else the time the record was stored, else NULL."""
    return F.coalesce(_col(ts), _col(ingested))
