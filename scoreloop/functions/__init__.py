"""Column builders. Everything here stays inside Spark's own expressions."""

from scoreloop.functions.coerce import nan_to_null, to_double, to_int, with_parsed_number
from scoreloop.functions.features import (
    error_metrics,
    log_feature,
    ratio_to_square,
    round_half_even,
)
from scoreloop.functions.identity import normalise_email, prediction_id, user_id
from scoreloop.functions.timestamps import (
    date_string,
    event_time,
    iso_utc,
    local_string,
    parse_any_timestamp,
    parse_timestamp,
    round_to_second,
    truncate_to_second,
)

__all__ = [
    "date_string", "error_metrics", "event_time", "iso_utc", "local_string",
    "log_feature", "nan_to_null", "normalise_email", "parse_any_timestamp",
    "parse_timestamp", "prediction_id", "ratio_to_square", "round_half_even",
    "round_to_second", "to_double", "to_int", "truncate_to_second", "user_id",
    "with_parsed_number",
]
