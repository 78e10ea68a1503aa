"""The registered queries as plain SQL, for an independent engine to check.

Written from the definition of each operator, not from its Spark plan: the
match is a join over all pairs, ranks are window functions, patches are
replayed with ordered aggregates.
"""

from __future__ import annotations

import random

PRED, REAL = "predicted_fat_percentage", "real_fat_percentage"


def half_even(expression: str, places: int) -> str:
    """The library's own rounding."""
    return f"(round_even(({expression}) * 1e{places}, 0) / 1e{places})"


def r(expression: str) -> str:
    """Every double of a result: six places, see ``catalog.tidy``."""
    return f"(round_even(({expression}) * 1e6 + 1e-4, 0) / 1e6 + 0.0::double)"


def r36(expression: str, places: int) -> str:
    """A metric rounded to its own places."""
    return r(half_even(expression, places))


EMAIL = "'User' || user_id || '@Example.com'"

LOG = f"""log as (
  select event_id, event_id::varchar as prediction_id, user_id::varchar as user_id, {EMAIL} as email, ts,
    value as pred, (10 + user_id % 91)::int as age,
    case when user_id % 2 = 0 then 'Male' else 'Female' end as gender,
    30 + (event_id % 1700) / 10.0::double as weight_kg,
    1.2::double + (user_id % 100) / 100.0::double as height_m,
    (80 + event_id % 141)::int as max_bpm, (60 + event_id % 141)::int as avg_bpm,
    (30 + event_id % 91)::int as resting_bpm,
    0.1::double + (event_id % 40) / 10.0::double as session_duration_hours,
    value * 10 as calories_burned,
    case event_id % 3 when 0 then 'Cardio' when 1 then 'Strength' else 'Mixed' end as workout_type,
    (event_id % 101) / 10.0::double as water_intake_liters,
    (1 + event_id % 7)::int as workout_frequency_days_week,
    (1 + event_id % 4)::varchar as experience_level
  from events)"""

FEEDBACK = f"""feedback as (
  select case when event_id % 11 = 0 then null when event_id % 12 = 0 then ''
      when event_id % 13 = 0 then (event_id + 100000000)::varchar else event_id::varchar end as prediction_id,
    user_id::varchar as user_id, {EMAIL} as email,
    ts + to_microseconds((event_id % 5 - 2) * 200000) as ts,
    value * (1 + (event_id % 7 - 3) / 20.0::double) as y,
    case when event_type = 'click' then value end as pred
  from events where event_type in ('view', 'click'))"""

SECOND = "round_even(epoch_us(ts) / 1e6::double, 0)"
DAY = "case when hour(ts) > 0 then date_trunc('day', ts) end"

PAIRS = f"""pairs as (
  select p.user_id, p.email, p.s, p.pred, f.y, f.pred as own
  from (select *, {SECOND} as s from log) p join (select *, {SECOND} as s from feedback) f
    on p.user_id is not distinct from f.user_id and p.email is not distinct from f.email
   and p.s is not distinct from f.s)"""

DAY_PAIRS = f"""pairs as (
  select p.user_id, p.email, p.pred, f.y, f.pred as own
  from (select *, {DAY} as s from log) p join (select *, {DAY} as s from feedback) f
    on p.user_id is not distinct from f.user_id and p.email is not distinct from f.email
   and p.s is not distinct from f.s)"""

HOT_GROUP = "'group' || (user_id::int % 3)::varchar"
MONTH = "date_trunc('month', ts)"

HOT_PAIRS = f"""pairs as (
  select p.pred, f.y, f.pred as own
  from (select *, {MONTH} as s, {HOT_GROUP} as g from log) p join (select *, {MONTH} as s, {HOT_GROUP} as g from feedback) f
    on p.g = f.g and p.s = f.s)"""

PATCHED = f"""{LOG}, {FEEDBACK},
repeated as (
  select prediction_id, ts, y, pred from feedback
  union all
  select prediction_id, ts + interval 1 hour, y * 1.1::double, null from feedback where pred is not null),
patches as (
  select prediction_id, ts, y, pred,
    {half_even('abs(y - pred)', 3)} as abs_error, {half_even('y - pred', 3)} as signed_error,
    {half_even('abs(y - pred) / nullif(y, 0) * 100', 2)} as relative_error
  from repeated where coalesce(prediction_id, '') <> ''),
last_label as (
  select * from patches qualify row_number() over (partition by prediction_id order by ts desc, y desc, pred desc nulls last) = 1),
last_error as (
  select * from patches where pred is not null
  qualify row_number() over (partition by prediction_id order by ts desc, y desc, pred desc) = 1),
patched as (
  select coalesce(b.prediction_id, l.prediction_id) as prediction_id, b.email, b.ts, b.pred, l.y, l.ts as feedback_ts,
    e.pred as pred_feedback, e.abs_error, e.signed_error, e.relative_error
  from log b full outer join last_label l on b.prediction_id = l.prediction_id
  left join last_error e on e.prediction_id = coalesce(b.prediction_id, l.prediction_id))"""

# A record counts where a label and a prediction are there, the latter from either column.
BOTH_SIDES = """sides as (
  select email, y, coalesce(pred, pred_feedback) as pred from patched
  where y is not null and (pred is not null or pred_feedback is not null))"""

PATCHED_ROWS = f"""with {PATCHED}
select prediction_id, email, epoch_us(ts) as timestamp, {r('pred')} as {PRED}, {r('y')} as {REAL},
  epoch_us(feedback_ts) as feedback_timestamp, {r('pred_feedback')} as {PRED}_feedback,
  {r('abs_error')} as abs_error, {r('signed_error')} as signed_error, {r('relative_error')} as relative_error
from patched"""

TRAINING = """training as (
  select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey as row_key, l_partkey, l_suppkey,
    l_quantity, l_discount, l_tax, p_size, p_retailprice, l_extendedprice / (l_quantity * l_quantity) as ratio,
    ln(1 + l_quantity) as log_quantity, l_returnflag, l_linestatus,
    10 + 5 * ln(l_quantity) + 40 * l_discount + case when l_returnflag = 'A' then 2 else 0 end
      + (l_partkey % 7 - 3) / 3.0::double as y
  from lineitem join part on l_partkey = p_partkey),
gaps as (
  select * replace (case when l_partkey % 10 <> 0 then l_tax end as l_tax,
    case when l_suppkey % 9 <> 0 then l_returnflag end as l_returnflag) from training)"""

TEXT_TIME = "case when email not like 'User7%' then ts end"
BUCKET = "('0x' || substr(md5('42:' || {k}), 1, 8))::bigint % 100 < 20"


def iso(ts: str) -> str:
    return (
        f"strftime({ts}, '%Y-%m-%dT%H:%M:%S') || "
        f"case when epoch_us({ts}) % 1000000 <> 0 then strftime({ts}, '.%f') else '' end || '+00:00'"
    )


def error_summary(source: str, by: str = "") -> str:
    select, group = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"""
select {select}count(*) as count, {r36('avg(abs(y - pred))', 3)} as mae,
  case when count(*) >= 2 then {r36('sqrt(avg((y - pred) * (y - pred)))', 3)} end as rmse,
  {r36('avg(y - pred)', 3)} as mean_signed_error,
  {r36('avg(abs(y - pred) / nullif(y, 0) * 100)', 2)} as mean_relative_error
from {source} {group} having count(*) > 0"""


def regression(y: str, p: str, scale: int = 1) -> dict[str, str]:
    e = f"({y} - {p})"
    return {
        "mae": r(f"avg(abs({e})) / {scale}"),
        "mse": r(f"avg({e} * {e})"),
        "rmse": r(f"sqrt(avg({e} * {e})) / {scale}"),
        "r2": r(f"1 - sum({e} * {e}) / nullif(var_pop({y}) * count(*), 0)"),
    }


def quantile_row(c: str) -> str:
    q = [r(f"quantile_cont({c}::double, {p})") for p in (0.25, 0.5, 0.75)]
    return f"""select '{c}' as column, count({c}) as count, {r(f'avg({c})')} as mean, {r(f'stddev_samp({c})')} as std,
  {r(f'min({c})')} as min, {q[0]} as p25, {q[1]} as p50, {q[2]} as p75, {r(f'max({c})')} as max from lineitem"""


def union(parts) -> str:
    return "\nunion all\n".join(parts)


DRIFT = {"value": "value", "props_length": "length(props)", "ln_value": "ln(nullif(value, 0))", "log1p_value": "ln(1 + value)"}

TRAINING_TYPES = {
    "row_key": "string", "l_partkey": "bigint", "l_suppkey": "bigint", "l_quantity": "double", "l_discount": "double",
    "l_tax": "double", "p_size": "int", "p_retailprice": "double", "ratio": "double", "log_quantity": "double",
    "l_returnflag": "string", "l_linestatus": "string", "y": "double",
}
CUSTOMER_TYPES = {
    "c_custkey": "bigint", "c_name": "string", "c_nationkey": "int", "c_acctbal": "double", "c_mktsegment": "string",
}
BALANCE_BAD = "not coalesce(c_acctbal between 0 and 9000, false)"
SEGMENT_BAD = "not coalesce(c_mktsegment in ('MACHINERY', 'BUILDING', 'AUTOMOBILE', 'HOUSEHOLD'), false)"
NAME_BAD = "not coalesce(length(c_name) >= 3, false)"

UPSERT = f"""with e as (
  select user_id::varchar as user_id, {EMAIL} as email, ts, value, user_id as u,
    event_type in ('click', 'view') as again from events),
rows as (
  select user_id, email, ts, value as pred, (10 + u % 91)::int as age, 0 as gen from e
  union all select user_id, email, ts, value * 2, 99, 1 from e where again),
stored as (
  select * from rows qualify row_number() over (partition by user_id, email, ts order by gen desc, pred desc, age desc) = 1)"""


HASH = "('0x' || substr(md5('42:' || row_key), 1, 8))::bigint"
FOLD = f"({HASH} % 3)::int"
SPLIT = f"""parts as (select row_key, case when {BUCKET.format(k='row_key')} then 'test' else 'train' end as split from training)"""

REQUEST_OK = """age between 10 and 100 and weight_kg between 30 and 200 and height_m between 1.2 and 2.2
        and max_bpm between 80 and 220 and avg_bpm between 60 and 200 and resting_bpm between 30 and 120
        and session_duration_hours between 0.1 and 4 and calories_burned between 0 and 5000
        and water_intake_liters between 0 and 10 and workout_frequency_days_week between 1 and 7
        and experience_level in ('1', '2', '3')"""

SCORED = f"""select replace(lower(email), '@', '_') || '__' || strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as prediction_id,
      lower(email) as email, epoch_us(date_trunc('second', ts)) as timestamp, true as in_range, true as two_places,
      {r('weight_kg / (height_m * height_m)')} as bmi from log"""


def draws(n: int) -> list[tuple[int, int, int, int]]:
    """The first seeded draws from the ranges 50-500, 3-20, 2-10 and 1-10."""
    rng = random.Random(42)
    return [(rng.randint(50, 500), rng.randint(3, 20), rng.randint(2, 10), rng.randint(1, 10)) for _ in range(n)]


def train_test() -> str:
    m = regression("y", "p")
    return f"""with {TRAINING},
scored as (
  select *, 10 + 5 * ln(l_quantity) + 40 * l_discount as p,
    case when {BUCKET.format(k='row_key')} then 'test' else 'train' end as split from training)
select split, count(*) as n, {m['mae']} as mae, {m['mse']} as mse, {m['rmse']} as rmse, {m['r2']} as r2
from scored group by split"""


def match_metrics(pairs: str, fan_out: bool, pred: str = "pred") -> str:
    m = regression("y", "pred")
    extra = "" if fan_out else (
        f"{r('avg(y - pred)')} as mean_signed_error, {r('avg(abs(y - pred) / nullif(y, 0) * 100)')} as mean_relative_error,"
    )
    return f"""with {LOG}, {FEEDBACK}, {pairs}
select count(*) as n, {m['mae']} as mae, {m['rmse']} as rmse, {r('avg(pred - y)')} as bias, {extra} {m['r2']} as r2
from (select y, {pred} as pred from pairs) where y is not null and pred is not null having count(*) > 0"""


def scaled(c: str, table: str) -> str:
    return f"({c} - (select avg({c}) from {table})) / (select coalesce(nullif(stddev_pop({c}), 0), 1) from {table})"


def profile(types: dict[str, str], source: str, ctes: str) -> str:
    rows = union(
        f"select {i} as ordinal, '{c}' as column, '{t}' as dtype, count(*) as rows, count({c}) as non_null from {source}"
        for i, (c, t) in enumerate(types.items())
    )
    return f"with {ctes} {rows}"


def pair_grid(table: str, columns: list[str], bins: int, edges: bool = True) -> str:
    """Joint counts on equal-width grids, from the definition: bins of both columns by their own span."""
    at = "case when {h} = {l} then {b} else least(floor(({v} - {l}) / (({h} - {l}) / {b})) + 1, {b}) end::int"
    parts = []
    for i, x in enumerate(columns):
        for y in columns[i + 1:]:
            cut = ", ".join(at.format(v=f"{c}::double", l=f"{s}l", h=f"{s}h", b=bins) + f" as {s}_bin" for s, c in (("x", x), ("y", y)))
            lows = ", ".join(
                f"{r(f'{s}l + ({s}h - {s}l) / {bins} * ({s}_bin - 1)')} as {s}_low, {r(f'{s}l + ({s}h - {s}l) / {bins} * {s}_bin')} as {s}_high"
                for s in "xy"
            )
            parts.append(f"""select '{x}' as x_name, '{y}' as y_name, x_bin, y_bin, {lows + ',' if edges else ''} coalesce(n, 0) as rows
              from (select unnest(range(1, {bins + 1}))::int as x_bin) cross join (select unnest(range(1, {bins + 1}))::int as y_bin)
              cross join (select min({x})::double as xl, max({x})::double as xh, min({y})::double as yl, max({y})::double as yh from {table})
              left join (select x_bin, y_bin, count(*) as n from (select {cut} from {table},
                (select min({x})::double as xl, max({x})::double as xh, min({y})::double as yl, max({y})::double as yh from {table})
                where {x} is not null and {y} is not null) group by all) using (x_bin, y_bin)""")
    return union(parts)


ORACLE: dict[str, str] = {
    "csv_round_trip": f"select c_custkey, c_name, {r('c_acctbal')} as c_acctbal, c_mktsegment from customer",
    "csv_inferred": union(
        f"select {i} as ordinal, '{c}' as column, '{t}' as dtype, count(*) as rows, count({v}) as non_null from lineitem"
        for i, (c, t, v) in enumerate([
            ("l_orderkey", "int", "1"), ("l_linenumber", "int", "1"), ("l_extendedprice", "double", "1"), ("l_returnflag", "string", "1"),
            ("l_shipdate", "timestamp", "1"), ("nothing", "string", "null"),
        ])
    ),
    "csv_bad_lines": f"""select case when c_custkey % 10 <> 0 then c_custkey end as c_custkey, c_name,
      case when c_custkey % 11 <> 0 then {r('c_acctbal')} end as c_acctbal,
      case when c_custkey % 10 = 0 or c_custkey % 11 = 0 then 'set aside' else 'read' end as route from customer""",
    "make_dataset_from_csv": f"""with {LOG} select prediction_id, age, {r('weight_kg')} as weight_kg, {r('height_m')} as height_m,
      {r('weight_kg / (height_m * height_m)')} as bmi, {r('ln(age::double)')} as log_age from log""",
    "append_log_sink": """select o_orderstatus, count(*) as rows, sum(o_orderkey)::bigint as key_sum
      from (select * from orders union all select * from orders where o_orderstatus = 'F') group by o_orderstatus""",
    "optional_table": f"with {LOG} select count(*) as predictions, 0::bigint as feedback, count(distinct email) as users from log",
    "feature_group_upsert": f"""{UPSERT} select user_id, email, epoch_us(ts) as timestamp, {r('pred')} as {PRED}, age,
      strftime(ts, '%Y-%m-%d') as date from stored""",
    "feature_group_versions": f"""{UPSERT}, states as (
        select 'first' as state, ts, age, pred from rows where gen = 0
        union all select 'last', ts, age, pred from stored union all select 'folded', ts, age, pred from stored)
      select state, strftime(ts, '%Y-%m-%d') as date, count(*) as rows, count(*) filter (age = 99) as replaced, {r('sum(pred)')} as total
      from states group by 1, 2""",
    "feature_view": f"""{UPSERT} select user_id, count(*) as rows, {r('avg(age)')} as age, {r('avg(pred)')} as label
      from stored group by user_id""",
    "feature_group_backfill": f"""with {LOG}, t as (select *, {TEXT_TIME} as parsed from log)
      select user_id, email, prediction_id, epoch_us(parsed) as timestamp, {r('pred')} as {PRED},
        strftime(parsed, '%Y-%m-%d') as date from t""",
    "versioned_datasets": f"select c_custkey, {r('c_acctbal')} as c_acctbal, {r('c_acctbal * 3')} as scaled from customer",
    "version_list": """select 'orders' as entity, v as version, count(*) as rows from (
      select case o_orderstatus when 'F' then 'v1' when 'O' then 'v1_2025-01-02' else 'v2' end as v from orders) group by v""",
    "dataset_metadata": union(
        f"select 'v1' as version, count(*) as rows, {i} as ordinal, '{c}' as column, '{t}' as dtype from customer"
        for i, (c, t) in enumerate(CUSTOMER_TYPES.items())
    ),
    "inference_sample": f"select o_orderkey, {r('o_totalprice')} as o_totalprice from orders order by o_orderkey desc limit 5",
    "sync_predictions": f"""with {LOG} select prediction_id, substr(sha256(lower(email)), 1, 16) as user_id,
      epoch_us({TEXT_TIME}) as timestamp, experience_level::int as experience_level, workout_frequency_days_week,
      null::double as {REAL}, {r('weight_kg / (height_m * height_m)')} as bmi, {r('ln(1 + age::double)')} as log_age from log""",
    "sync_feedback": f"""with {FEEDBACK} select email, substr(sha256(lower(email)), 1, 16) as user_id,
      epoch_us({TEXT_TIME}) as timestamp, {r('y')} as {REAL} from feedback""",
    "feat_ratio_square": f"select l_orderkey, l_linenumber, {r('l_extendedprice / (l_quantity * l_quantity)')} as ratio from lineitem",
    "feat_logs": f"""select c_custkey, case when c_acctbal > 0 then {r('ln(case when c_acctbal > 0 then c_acctbal end)')} end as ln,
      {r('ln(1 + greatest(c_acctbal, 0.0::double))')} as log1p from customer""",
    "build_features": f"""with {LOG} select prediction_id, {r('weight_kg / (height_m * height_m)')} as bmi,
      {r('ln(1 + age::double)')} as log_age from log""",
    "log_skew": f"""with {LOG}, g as (select gender, ln(1 + age::double) - ln(age::double) as gap from log)
      select gender, count(gap) as n, {r('avg(gap)')} as mean_gap, {r('max(gap)')} as max_gap from g group by gender""",
    "rename_select_expected": f"""with {LOG} select gender as "Gender", workout_type as "Workout_Type", count(*) as rows,
      {r('avg(weight_kg / (height_m * height_m))')} as bmi, {r('avg(ln(1 + age::double))')} as log_age,
      {r('avg(weight_kg)')} as weight from log group by gender, workout_type""",
    "select_present_columns": f"""with {LOG} select {r('pred')} as {PRED}, {r('weight_kg')} as weight_kg,
      {r('session_duration_hours')} as session_duration_hours, workout_type, workout_frequency_days_week, avg_bpm, resting_bpm,
      max_bpm, {r('calories_burned')} as calories_burned, {r('water_intake_liters')} as water_intake_liters, experience_level,
      {r('height_m')} as height_m from log""",
    "drop_and_exclude": f"""with {LOG} select prediction_id, age, {r('weight_kg')} as weight_kg, {r('height_m')} as height_m,
      max_bpm, avg_bpm, resting_bpm, {r('session_duration_hours')} as session_duration_hours,
      {r('calories_burned')} as calories_burned, {r('water_intake_liters')} as water_intake_liters,
      workout_frequency_days_week from log""",
    "column_roles": f"with {TRAINING} " + union(
        f"select '{c}' as column, '{'categorical' if t == 'string' else 'numeric'}' as role, count(*) as rows from training"
        for c, t in TRAINING_TYPES.items()
    ),
    "parse_numbers": """select o_orderkey, case when o_orderstatus <> 'P' then o_orderkey::double end as as_double,
      case when o_orderstatus <> 'P' then o_orderkey::int end as as_int from orders""",
    "parse_numbers_keep_raw": """select o_orderkey,
      case when o_orderstatus = 'P' then 'n/a ' || o_orderpriority else o_orderkey::varchar end as price,
      case when o_orderstatus <> 'P' then o_orderkey::double end as price_number from orders""",
    "cast_columns": """select event_id as prediction_id, (1 + event_id % 4)::int as experience_level, null::int as workout_type,
      (10 + user_id % 91)::varchar as age from events""",
    "ts_parse": f"""with {LOG}, t as (select prediction_id, {TEXT_TIME} as p from log)
      select prediction_id, epoch_us(p) as micros, strftime(p, '%Y-%m-%d') as date from t""",
    "ts_polymorphic": """select event_id, case when event_id % 5 = 0 then epoch_us(ts)
      when event_id % 5 in (1, 2) then (epoch_us(ts) // 1000000) * 1000000 end as micros from events""",
    "ts_round_half_even": """with t as (select event_id, epoch_us(ts) as us, (epoch_us(ts) // 1000000) * 1000000 as whole from events)
      select event_id, (round_even(us / 1e6::double, 0) * 1000000)::bigint as rounded,
        (round_even((whole + event_id % 4 * 500000) / 1e6::double, 0) * 1000000)::bigint as rounded_tie, whole as truncated from t""",
    "ts_render": """with t as (select event_id, date_trunc('second', ts + to_microseconds(event_id * 3600000000)) as t from events),
      -- Fixed rule: summer time runs between 01:00 UTC on the last Sundays of March and October.
      y as (select *, make_timestamp(year(t)::int, 3, 31, 1, 0, 0.0) as m, make_timestamp(year(t)::int, 10, 31, 1, 0, 0.0) as o from t),
      z as (select *, m - to_days(dayofweek(m)::int) as s, o - to_days(dayofweek(o)::int) as e from y)
      select event_id, strftime(t, '%Y-%m-%dT%H:%M:%S+00:00') as iso,
        strftime(t + to_hours(case when t >= s and t < e then 2 else 1 end), '%Y-%m-%d %H:%M:%S') as madrid from z""",
    "ts_fallback": """select event_id, case when event_type <> 'error' then epoch_us(ts)
      when event_id % 2 = 0 then epoch_us(ts) + 1000000 end as micros from events""",
    "user_id_hash": "select c_custkey, substr(sha256(lower(c_name)), 1, 16) as user_id from customer",
    "email_normalise": "select c_custkey, lower(c_name) || '@example.com' as email from customer",
    "prediction_ids": f"""with {LOG} select prediction_id, replace(lower(email), '@', '_') || '__' ||
      strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' as new_id from log""",
    "row_error_metrics": f"""with {FEEDBACK} select email, epoch_us(ts) as timestamp, {r36('abs(y - pred)', 3)} as abs_error,
      {r36('y - pred', 3)} as signed_error, {r36('abs(y - pred) / nullif(y, 0) * 100', 2)} as relative_error
      from feedback where pred is not null""",
    "round_prediction": f"select l_orderkey, l_linenumber, {r36('l_extendedprice / 7', 2)} as rounded from lineitem",
    "coalesce_alternates": f"""with {FEEDBACK} select email, epoch_us(ts) as timestamp,
      {r('case when pred is null then y else y + 1 end')} as {REAL}, {r('coalesce(pred, y + 2)')} as {PRED} from feedback""",
    "schema_violations": union([
        "select 'p_size' as column, 'bigint' as expected, 'int' as actual, 'wrong_type' as problem, count(*) as rows from part",
        "select 'p_weight', 'double', null, 'missing', count(*) from part",
    ]),
    "domain_violations": union([
        f"select 'c_acctbal_domain' as rule, count(*) filter ({BALANCE_BAD}) as violations from customer",
        f"select 'c_mktsegment_domain', count(*) filter ({SEGMENT_BAD}) from customer",
        f"select 'c_name_domain', count(*) filter ({NAME_BAD}) from customer",
    ]),
    "domain_quarantine": f"""select c_custkey, concat_ws(',', case when {BALANCE_BAD} then 'c_acctbal_domain' end,
      case when {SEGMENT_BAD} then 'c_mktsegment_domain' end, case when {NAME_BAD} then 'c_name_domain' end) as reasons
      from customer where {BALANCE_BAD} or {SEGMENT_BAD} or {NAME_BAD}""",
    "domain_feedback": f"""with {FEEDBACK} select email, epoch_us(ts) as timestamp, {r('y')} as {REAL}, '{REAL}_domain' as reasons
      from feedback where not y between 1 and 80""",
    "domain_valid_requests": f"""with {LOG} select prediction_id, age, experience_level from log
      where {REQUEST_OK}""",
    "null_profile": f"""with {TRAINING} select * from (
      select 'l_tax' as column, count(*) filter (l_tax is null) as nulls from gaps
      union all select 'l_returnflag', count(*) filter (l_returnflag is null) from gaps) where nulls > 0""",
    "drop_missing": f"""with {TRAINING} select l_returnflag, count(*) as rows, {r('avg(l_tax)')} as tax from gaps
      where l_tax is not null and l_returnflag is not null group by l_returnflag""",
    "feedback_routing": f"""with {FEEDBACK} select email, epoch_us(ts) as timestamp, {r('y')} as {REAL},
      case when coalesce(prediction_id, '') <> '' then 'linked' else 'orphan' end as route from feedback""",
    "match_rows": f"""with {LOG}, {FEEDBACK}, {PAIRS} select user_id, email, (s * 1000000)::bigint as timestamp,
      {r('pred')} as y_pred, {r('y')} as y_true from pairs where pred is not null and y is not null""",
    "match_rows_fan_out": f"""with {LOG}, {FEEDBACK}, {DAY_PAIRS} select user_id, count(*) as n, {r('avg(pred)')} as y_pred,
      {r('avg(y)')} as y_true from pairs where pred is not null and y is not null group by user_id""",
    "monitor_join_metrics": match_metrics(PAIRS, False),
    "monitor_join_metrics_fan_out": match_metrics(DAY_PAIRS, True),
    "monitor_metrics_of_feedback": match_metrics(PAIRS, False, "coalesce(own, pred)"),
    "monitor_metrics_hot_keys": match_metrics(HOT_PAIRS, True),
    "hot_match_keys": f"""with {LOG}, {FEEDBACK}, both_logs as (
        select 'user' as user_id, email_group as email, {MONTH} as s from (select *, {HOT_GROUP} as email_group from log)
        union all
        select 'user', email_group, {MONTH} from (select *, {HOT_GROUP} as email_group from feedback where y is not null))
      select email, epoch_us(s) as timestamp, count(*) as rows from both_logs group by email, s having count(*) >= 100""",
    "monitor_metrics_large_values": f"""with pairs as (
        select l.l_extendedprice + 1e6::double as pred, o.o_totalprice / 4 + 1e6::double as y
        from lineitem l join orders o on l.l_orderkey = o.o_orderkey)
      select count(*) as n, {r('avg(abs(pred - y)) / 1000')} as mae_k, {r('sqrt(avg((pred - y) * (pred - y))) / 1000')} as rmse_k,
        {r('avg(pred - y) / 1000')} as bias_k, {r('1 - sum((pred - y) * (pred - y)) / nullif(var_pop(y) * count(*), 0)')} as r2 from pairs""",
    "top_users_by_mae": f"""with {LOG}, {FEEDBACK}, {DAY_PAIRS}
      select email, count(*) as n, {r('avg(abs(coalesce(own, pred) - y))')} as mae, {r('avg(y)')} as mean_real,
        {r('avg(pred)')} as mean_pred
      from pairs group by email order by avg(abs(coalesce(own, pred) - y)) desc, email limit 10""",
    "duplicate_match_keys": f"""with {LOG} select user_id, email, epoch_us({DAY}) as timestamp, count(*) as rows
      from log group by all having count(*) > 1""",
    "error_summary": f"""with {PATCHED}, {BOTH_SIDES} {error_summary('sides')}""",
    "error_summary_one_user": f"""with {PATCHED}, {BOTH_SIDES}, own as (
      select y, pred from sides where lower(trim(email)) = 'user42@example.com') {error_summary('own')}""",
    "error_summary_by_user": f"""with {PATCHED}, {BOTH_SIDES} {error_summary('sides', 'email')}""",
    "train_test_metrics": train_test(),
    "bias_metrics": f"""with {FEEDBACK} select count(*) as n, {r('avg(abs(pred - y))')} as mae,
      {r('sqrt(avg((pred - y) * (pred - y)))')} as rmse, {r('avg(pred - y)')} as bias
      from feedback where pred is not null having count(*) > 0""",
    "user_errors_top": f"""with {FEEDBACK} select email, count(*) as n, {r('avg(abs(pred - y))')} as mae, {r('avg(y)')} as mean_real,
      {r('avg(pred)')} as mean_pred from feedback group by email order by avg(abs(pred - y)) desc nulls last, email limit 10""",
    "drift_report": "with c as (select max(ts) - interval 7 day as cutoff from events),\nm as (" + union(
        f"""select '{name}' as feature, avg({e}) filter (ts < cutoff) as past, avg({e}) filter (ts >= cutoff) as recent,
          count(*) filter (ts < cutoff) as n_old, count(*) filter (ts >= cutoff) as n_new from events, c"""
        for name, e in DRIFT.items()
    ) + f""") select feature, {r36('past', 3)} as past_mean, {r36('recent', 3)} as recent_mean, {r36('recent - past', 3)} as abs_diff,
      {r36('(recent - past) / nullif(past, 0) * 100', 2)} as rel_diff_pct from m where n_old > 0 and n_new > 0""",
    "overview_counters": f"""with {LOG}, {FEEDBACK} select count(*) as predictions, (select count(*) from feedback) as feedback,
      count(distinct email) as users from log""",
    "describe_numeric": union(quantile_row(c) for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey")),
    "quantiles": union(
        f"select '{c}' as column, {p}::double as probability, {r(f'quantile_cont({c}::double, {p})')} as value from orders"
        for c in ("o_totalprice", "o_custkey") for p in (0.01, 0.5, 0.9, 0.999)
    ),
    "table_profile": profile(TRAINING_TYPES, "gaps", TRAINING),
    "histogram": f"""with s as (select min(p_retailprice) as lo, (max(p_retailprice) - min(p_retailprice)) / 16 as w from part),
      b as (select least(floor((p_retailprice - lo) / w) + 1, 16)::int as bin from part, s)
      select n.bin::int as bin, {r('lo + w * (n.bin - 1)')} as low, {r('lo + w * n.bin')} as high, count(b.bin) as rows
      from s, range(1, 17) n(bin) left join b on b.bin = n.bin group by n.bin, lo, w""",
    "histogram_sparse": """with x2 as (select c_acctbal * c_acctbal as v from customer), x4 as (select v * v as v from x2),
      x8 as (select v * v as v from x4), x16 as (select v * v as v from x8), x as (select v * v as v from x16),
      s as (select min(v) as lo, (max(v) - min(v)) / 200 as w from x),
      b as (select least(floor((v - lo) / w) + 1, 200)::int as bin from x, s)
      select n.bin::int as bin, count(b.bin) as rows from range(1, 201) n(bin) left join b on b.bin = n.bin group by n.bin""",
    "empty_reports": """select 'error_summary' as report, 0::bigint as rows union all select 'regression_metrics', 0
      union all select 'match_metrics', 0 union all select 'worst_users', 0 union all select 'histogram', 0 union all select 'describe', 0""",
    "match_two_keys": f"""with {LOG}, {FEEDBACK} select p.user_id, epoch_us(date_trunc('day', p.ts)) as timestamp, count(*) as n,
        {r('avg(abs(p.pred - f.y))')} as mae from log p join feedback f
        on p.user_id = f.user_id and date_trunc('day', p.ts) = date_trunc('day', f.ts)
      where f.y is not null and p.pred is not null group by all""",
    "pair_points": f"""select p_partkey, 'p_size' as x_name, 'p_retailprice' as y_name, p_size::double as x, {r('p_retailprice')} as y
      from part order by md5('42:' || p_partkey), p_partkey limit 200""",
    "label_range": f"""with {FEEDBACK} select user_id, {r('least(min(y), min(pred))')} as min, {r('greatest(max(y), max(pred))')} as max
      from feedback group by user_id""",
    "latest_per_key": f"""select o_custkey, o_orderkey, {r('o_totalprice')} as o_totalprice, o_orderstatus from orders
      qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) = 1""",
    "feedback_patch_merge": PATCHED_ROWS,
    "history_asc": f"""with {PATCHED} select prediction_id, email, {iso('ts')} as timestamp, {r('pred')} as {PRED}_number,
      {r('y')} as {REAL}_number from patched where email is not null""",
    "history_one_user": f"""with {LOG} select prediction_id, {iso('ts')} as timestamp, {r('pred')} as {PRED}_number from log
      where lower(email) = 'user3@example.com'""",
    "history_desc": f"""with {LOG} select strftime({TEXT_TIME} + interval 1 hour, '%Y-%m-%d %H:%M:%S') as timestamp, {r('pred')} as {PRED},
      {r('weight_kg')} as weight_kg, workout_type, avg_bpm, {r('height_m')} as height_m from log""",
    "latest_ten": f"with {LOG} select prediction_id, email, {r('pred')} as {PRED} from log order by ts desc, prediction_id desc limit 10",
    "head_rows": f"select o_orderkey, o_custkey, {r('o_totalprice')} as o_totalprice from orders order by orders.o_totalprice desc, o_orderkey limit 5",
    "training_rows": f"""with {PATCHED} select prediction_id, {r('y')} as {REAL}, {r('coalesce(pred, 0)')} as {PRED}
      from patched where y is not null""",
    "plain_lookup": f"""with {LOG} select prediction_id as doc_id, lower(email) as email, {r('pred')} as {PRED} from log
      where lower(email) = 'user12@example.com'""",
    "series_long": f"""with {FEEDBACK} select epoch_us(ts) as timestamp, 'Real' as serie, {r('y')} as value from feedback
      union all select epoch_us(ts), 'Predicción', {r('pred')} from feedback where pred is not null""",
    "standard_scale": f"""select p_partkey, {r(scaled('p_size', 'part'))} as p_size_scaled,
      {r(scaled('p_retailprice', 'part'))} as p_retailprice_scaled, 0.0::double as constant_scaled from part""",
    "one_hot_wide": f"with {TRAINING} select row_key, " + ", ".join(
        f"case when {c} = '{v}' then 1.0::double else 0.0::double end as {c}_{v}"
        for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs
    ) + " from gaps",
    "prepared_vector": f"with {TRAINING} select row_key, {r(scaled('l_quantity', 'gaps'))} as l_quantity, "
    f"{r(scaled('l_discount', 'gaps'))} as l_discount, " + ", ".join(
        f"case when l_returnflag = '{v}' then 1.0::double else 0.0::double end as flag_{v.lower()}" for v in "ANR"
    ) + " from gaps",
    "wide_feature_table": f"select c_custkey, {r(scaled('c_acctbal', 'customer'))} as c_acctbal, " + ", ".join(
        f"case when c_mktsegment = '{v}' then 1.0::double else 0.0::double end as \"c_mktsegment_{v}\""
        for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    ) + " from customer",
    "impute_median_mode": f"""with {TRAINING}, m as (select quantile_cont(l_tax, 0.5) as tax from gaps),
      f as (select l_returnflag as flag from gaps where l_returnflag is not null group by 1 order by count(*) desc, 1 limit 1)
      select row_key, {r('coalesce(l_tax, (select tax from m))')} as l_tax,
        coalesce(l_returnflag, (select flag from f)) as l_returnflag from gaps""",
    "split_exact": """select o_orderkey, case when row_number() over (order by md5('42:' || o_orderkey), o_orderkey)
      <= ceil(0.2 * count(*) over ()) then 'test' else 'train' end as split from orders""",
    "split_bucket": f"select o_orderkey, case when {BUCKET.format(k='o_orderkey')} then 'test' else 'train' end as split from orders",
    "folds_contiguous": "select o_orderkey, (ntile(7) over (order by o_orderkey) - 1)::int as fold from orders",
    "pair_grid": pair_grid("part", ["p_partkey", "p_size", "p_retailprice"], 8),
    "pair_grid_lines": pair_grid("lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 10, edges=False),
    "stream_feedback": PATCHED_ROWS,
    "stream_feedback_orphans": f"""with {FEEDBACK}, loose as (select * from feedback where coalesce(prediction_id, '') = '')
      select email, epoch_us(ts) as timestamp, {r('y')} as {REAL} from loose union all
      select email, epoch_us(ts + interval 1 hour), {r('y * 1.1::double')} from loose where pred is not null""",
    "stream_sync_predictions": f"""with {LOG}, t as (select *, {TEXT_TIME} as parsed from log)
      select prediction_id, substr(sha256(lower(email)), 1, 16) as user_id, epoch_us(parsed) as timestamp,
        strftime(parsed, '%Y-%m-%d') as date, experience_level::int as experience_level, null::double as {REAL},
        {r('weight_kg / (height_m * height_m)')} as bmi, {r('ln(1 + age::double)')} as log_age from t""",
    "stream_sync_feedback": f"""with {FEEDBACK}, t as (select email, {TEXT_TIME} as parsed, prediction_id from feedback)
      select email, substr(sha256(lower(email)), 1, 16) as user_id, epoch_us(parsed) as timestamp,
        strftime(parsed, '%Y-%m-%d') as date, max(prediction_id) as prediction_id from t group by email, parsed""",
    "stream_score_distinct": f"""with {LOG}, once as ({SCORED} where {REQUEST_OK})
      select distinct prediction_id, email, timestamp, in_range, two_places from once""",
    "stream_feedback_distinct": f"""with {FEEDBACK}, routed as (
        select y, case when not y between 1 and 80 then 'broken' when coalesce(prediction_id, '') = '' then 'orphan' else 'patched' end as route
        from feedback)
      select route, count(*) as rows, {r('sum(y)')} as total from routed group by route""",
    "forest_fit": f"with {TRAINING}, {SPLIT} select split, count(*) as n, true as good from parts group by split",
    "numeric_baseline": f"with {TRAINING} select count(*) as n, true as good from training",
    "cv_mean_r2": f"with {TRAINING} select 0 as trial, {FOLD} as fold, count(*) as n, true as good from training group by all",
    "cv_contiguous": f"""with {TRAINING}, places as (
        select distinct split_part(row_key, '-', 1)::bigint * 10 + split_part(row_key, '-', 2)::bigint as place from training),
      folds as (select (ntile(3) over (order by place) - 1)::int as fold from places)
      select 0 as trial, fold, count(*) as n, true as good from folds group by fold""",
    "search_trials": f"with {TRAINING}, drawn as (" + union(
        f"select {i} as trial, {t} as trees, {d} as depth, {split} as min_split, {leaf} as min_leaf" for i, (t, d, split, leaf) in enumerate(draws(2) + [(t // 2, d, 10, leaf) for t, d, _, leaf in draws(2)])
    ) + ") select drawn.*, (select count(*) from training) as n, true as best_is_top, true as good from drawn",
    "tune_and_refit": f"with {TRAINING} select count(*) as n, 20 as best_depth, true as good from training",
    "training_report": f"""with {TRAINING}, {SPLIT} select 'y' as target, (select count(*) from training) as n_rows,
      9 as n_features_before, split, count(*) as n, true as good from parts group by split""",
    "register_and_load": "select 1 as version, false as unknown, true as good union all select 2, true, false",
    "batch_score": f"""with {TRAINING} select distinct substr(sha256(lower(row_key)), 1, 16) as user_id, row_key as email,
      epoch_us(timestamp '2024-01-01') + {HASH} % 28 * 86400000000 as timestamp, true as in_range from training""",
    "score_records": f"with {LOG} {SCORED}",
    "stream_score": f"with {LOG} {SCORED} where {REQUEST_OK}",
    "stream_score_routes": f"""with {LOG} select count(*) as rows, case when {REQUEST_OK} then 'scored' else 'set aside' end as route
      from log group by all""",
    "model_compare": f"""with {TRAINING}, {SPLIT}, t as (select count(*) as n from parts where split = 'test')
      select 'large' as model, n, true as best from t union all select 'small', n, false from t""",
}

_m = regression("l_extendedprice", "(2100 * l_quantity + 5 * l_linenumber)", 1000)
ORACLE["regression_metrics_r2"] = f"""select l_returnflag, l_linestatus, count(*) as n, {_m['mae']} as mae_k, {_m['rmse']} as rmse_k,
  {_m['r2']} as r2 from lineitem group by l_returnflag, l_linestatus"""
ORACLE["prepared_vector_reloaded"] = ORACLE["prepared_vector"]
