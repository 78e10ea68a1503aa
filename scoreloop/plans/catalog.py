"""Registered queries: every operator over whole tables of a test data folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scoreloop.functions import (
    date_string, error_metrics, event_time, iso_utc, local_string, log_feature, normalise_email, parse_any_timestamp,
    parse_timestamp, prediction_id, ratio_to_square, round_half_even, round_to_second, to_double, to_int,
    truncate_to_second, user_id, with_parsed_number,
)
from scoreloop.functions.vocabulary import FEATURE_FIELDS, HISTORY_COLUMNS, MODEL_COLUMNS, PREDICTED, REAL, SCORING_NAMES
from scoreloop.operators import drift, forest, hot, ledger, match, metrics, order_stats, prep, profile, project, quality, split
from scoreloop.plans import fixtures as fx
from scoreloop.plans import monitoring, scoring, training
from scoreloop.session import configure, scratch_dir, stored
from scoreloop.sources import feature_groups as groups
from scoreloop.sources.feature_store import FeatureStore, metadata_frame
from scoreloop.sources.files import append_log, child_files, delete, infer_csv_schema, make_dataset, read_csv, read_optional, split_csv, write_csv
from scoreloop.sources.registry import ModelRegistry, load_preparation, save_preparation
from scoreloop.streaming.feedback import LedgerSnapshot, apply_feedback_stream, read_feedback
from scoreloop.streaming.score import read_requests, score_stream
from scoreloop.streaming.sync import sync_feedback_stream, sync_prediction_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Forests of the registered queries: unlimited depth, every feature, few trees, and the
# library's bound on fit rows set lower. All rows are prepared, split and scored.
MODEL = {"trees": 10, "fit_rows": 5_000, "partitions": 8}
# JSON keeps milliseconds unless told otherwise.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six places, so that summation order does not show.

    The small offset keeps exact ties, which means of short decimals often
    are, from falling either way with the last bit of a sum.
    """
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)]
    return df.withColumns({c: F.rint(F.col(f"`{c}`") * 1e6 + 1e-4) / 1e6 + 0.0 for c in doubles}) if doubles else df


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(fn(configure(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def micros(c) -> F.Column:
    return F.unix_micros(c)


# ---- sources, sinks, versions ---------------------------------------------

@query
def csv_round_trip(spark, sf):
    df = fx.table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    path = scratch_dir(spark, "csv")
    write_csv(df, path)
    return read_csv(spark, path, df.schema)


@query
def csv_inferred(spark, sf):
    """Types inferred from the text of a table, and the rows they read."""
    df = fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    path = scratch_dir(spark, "csv")
    write_csv(df.withColumn("nothing", F.lit(None).cast("string")), path)
    return profile.table_profile(read_csv(spark, path, infer_csv_schema(spark, path)))


@query
def csv_bad_lines(spark, sf):
    """Lines that do not fit are kept aside and none is lost."""
    key, balance = F.col("c_custkey"), F.col("c_acctbal")
    texts = fx.table(spark, sf, "customer").select(
        F.when(key % 10 == 0, F.concat(F.lit("no key "), key)).otherwise(key.cast("string")).alias("c_custkey"), "c_name",
        F.when(key % 11 == 0, "not, a number").otherwise(balance.cast("string")).alias("c_acctbal"),
    )
    path, bad = scratch_dir(spark, "csv"), scratch_dir(spark, "bad")
    write_csv(texts, path)
    good = split_csv(spark, path, bad, "c_custkey bigint, c_name string, c_acctbal double")
    return good.select("c_custkey", "c_name", "c_acctbal", F.lit("read").alias("route")).unionByName(
        spark.read.parquet(bad).select("c_custkey", "c_name", "c_acctbal", F.lit("set aside").alias("route"))
    )


@query
def make_dataset_from_csv(spark, sf):
    raw = fx.prediction_log(spark, sf).select("prediction_id", "age", "weight_kg", "height_m")
    source, target = scratch_dir(spark, "raw"), scratch_dir(spark, "interim")
    write_csv(raw, source)
    return make_dataset(spark, source, target, raw.schema, log_kind="ln")


@query
def append_log_sink(spark, sf):
    path = scratch_dir(spark, "log")
    orders = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    append_log(orders, path)
    append_log(orders.filter("o_orderstatus = 'F'"), path)
    return read_optional(spark, path, orders.schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("rows"), F.sum("o_orderkey").alias("key_sum")
    )


@query
def optional_table(spark, sf):
    log = fx.prediction_log(spark, sf)
    schema = "prediction_id string, real_fat_percentage double"
    return drift.overview(log, read_optional(spark, scratch_dir(spark, "absent"), schema))


def _event_group(spark, sf) -> tuple[str, groups.TableSpec]:
    """Events inserted by (user, time), then clicks and views again with a new value."""
    root = scratch_dir(spark, "groups")
    spec = groups.TableSpec("event_values", 1, ("user_id", "email"), "timestamp", "date")
    log = fx.prediction_log(spark, sf).select("user_id", "email", "timestamp", PREDICTED, "age")
    groups.insert(spark, root, spec, log)
    clicks = fx.events(spark, sf).filter("event_type in ('click', 'view')").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.concat(F.lit("User"), "user_id", F.lit("@Example.com")).alias("email"),
        F.col("ts").alias("timestamp"), (F.col("value") * 2).alias(PREDICTED), F.lit(99).alias("age"),
    )
    groups.insert(spark, root, spec, clicks)
    return root, spec


@query
def feature_group_upsert(spark, sf):
    root, spec = _event_group(spark, sf)
    return groups.read_group(spark, root, spec.name).withColumn("timestamp", micros("timestamp"))


@query
def feature_group_versions(spark, sf):
    """Two commits of one table, each read while the other is there, and the same after compaction."""
    root, spec = _event_group(spark, sf)
    first = groups.read_group(spark, root, spec.name, commit=1)
    last = groups.read_group(spark, root, spec.name)
    groups.compact_group(spark, root, spec.name)
    folded = groups.read_group(spark, root, spec.name)
    return reduce(DataFrame.unionByName, [
        df.groupBy("date").agg(F.count("*").alias("rows"), F.count_if(F.col("age") == 99).alias("replaced"), F.sum(PREDICTED).alias("total"))
        .withColumn("state", F.lit(name))
        for name, df in (("first", first), ("last", last), ("folded", folded))
    ])


@query
def feature_view(spark, sf):
    root, spec = _event_group(spark, sf)
    groups.create_or_get_view(spark, root, "ages", spec, ["age"], [PREDICTED], ["user_id"])
    return groups.read_view(spark, root, "ages").groupBy("user_id").agg(
        F.count("*").alias("rows"), F.avg("age").alias("age"), F.avg(PREDICTED).alias("label")
    )


@query
def feature_group_backfill(spark, sf):
    log = fx.log_with_text_times(fx.prediction_log(spark, sf)).select(
        "user_id", "email", "prediction_id", "timestamp", PREDICTED
    )
    path, root = scratch_dir(spark, "history"), scratch_dir(spark, "groups")
    write_csv(log, path)
    spec = groups.TableSpec("history", 1, ("user_id", "email", "prediction_id"), "timestamp", "date")
    groups.backfill(spark, root, spec, path, log.schema)
    return groups.read_group(spark, root, "history").withColumn("timestamp", micros("timestamp"))


@query
def versioned_datasets(spark, sf):
    """Four saved versions; the latest dated v1 is the one loaded."""
    store = FeatureStore(spark, scratch_dir(spark, "store"))
    df = fx.table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    for version, factor in (("v1", 1.0), ("v1_2025-01-02", 2.0), ("v2_2025-02-01", 4.0)):
        store.save(df.withColumn("scaled", F.col("c_acctbal") * factor), "customers", version)
    store.save(df.withColumn("scaled", F.col("c_acctbal") * 3.0), "customers", "v1", True, date(2025, 1, 10))
    return store.load("customers", "v1", latest_if_available=True)


@query
def version_list(spark, sf):
    store = FeatureStore(spark, scratch_dir(spark, "store"))
    df = fx.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    for status, version in (("F", "v1"), ("O", "v1_2025-01-02"), ("P", "v2")):
        part = df.filter(F.col("o_orderstatus") == status)
        store.save(part, "orders", version)
        store.track_metadata(part, "orders", version)
    counts = {v: store.metadata("orders", v)["rows"] for v in store.versions("orders")}
    listed = store.versions_frame("orders")
    return listed.withColumn("rows", F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])[F.col("version")].cast("bigint"))


@query
def dataset_metadata(spark, sf):
    return metadata_frame(fx.table(spark, sf, "customer"), "v1")


@query
def inference_sample(spark, sf):
    store = FeatureStore(spark, scratch_dir(spark, "store"))
    path = store.save_inference_sample(fx.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "orders", "o_orderkey")
    return spark.read.parquet(path)


@query
def sync_predictions(spark, sf):
    return ledger.sync_predictions(fx.log_with_text_times(fx.prediction_log(spark, sf))).select(
        "prediction_id", "user_id", micros("timestamp").alias("timestamp"), "experience_level",
        "workout_frequency_days_week", REAL, "bmi", "log_age",
    )


@query
def sync_feedback(spark, sf):
    return ledger.sync_feedback(fx.log_with_text_times(fx.feedback_log(spark, sf))).select(
        "email", "user_id", micros("timestamp").alias("timestamp"), REAL
    )


# ---- expressions ----------------------------------------------------------

@query
def feat_ratio_square(spark, sf):
    return fx.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", ratio_to_square("l_extendedprice", "l_quantity").alias("ratio")
    )


@query
def feat_logs(spark, sf):
    return fx.table(spark, sf, "customer").select(
        "c_custkey", log_feature("c_acctbal", "ln").alias("ln"),
        log_feature(F.greatest(F.col("c_acctbal"), F.lit(0.0)), "log1p").alias("log1p"),
    )


@query
def build_features(spark, sf):
    return project.build_features(fx.prediction_log(spark, sf)).select("prediction_id", "bmi", "log_age")


@query
def log_skew(spark, sf):
    return project.log_skew(fx.prediction_log(spark, sf), by=["gender"])


@query
def rename_select_expected(spark, sf):
    named = project.rename(project.build_features(fx.prediction_log(spark, sf)), SCORING_NAMES)
    return project.select_expected(named, MODEL_COLUMNS).groupBy("Gender", "Workout_Type").agg(
        F.count("*").alias("rows"), F.avg("BMI").alias("bmi"), F.avg("Log_Age").alias("log_age"), F.avg("Weight (kg)").alias("weight")
    )


@query
def select_present_columns(spark, sf):
    return project.select_present(fx.prediction_log(spark, sf), [*HISTORY_COLUMNS[1:], "not_there"])


@query
def drop_and_exclude(spark, sf):
    x, _ = project.split_target(fx.prediction_log(spark, sf), PREDICTED)
    keep = project.feature_columns(x, {"user_id", "email", "timestamp", "gender", "workout_type", "experience_level"})
    return x.select(*keep)


@query
def column_roles(spark, sf):
    df = fx.training_set(spark, sf)
    numeric, categorical = project.column_roles(df)
    role = F.when(F.col("column").isin(numeric), "numeric").when(F.col("column").isin(categorical), "categorical")
    return metadata_frame(df, "v1").select("column", role.alias("role"), "rows")


def _texts(spark, sf) -> DataFrame:
    """Order prices as text, unusable for one status."""
    return fx.table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("n/a "), "o_orderpriority"))
        .otherwise(F.col("o_orderkey").cast("string")).alias("price"),
    )


@query
def parse_numbers(spark, sf):
    return _texts(spark, sf).select("o_orderkey", to_double("price").alias("as_double"), to_int("price").alias("as_int"))


@query
def parse_numbers_keep_raw(spark, sf):
    return with_parsed_number(_texts(spark, sf), "price")


@query
def cast_columns(spark, sf):
    return project.cast_columns(
        fx.prediction_log(spark, sf).select("prediction_id", "experience_level", "workout_type", "age"),
        {"prediction_id": "bigint", "experience_level": "int", "workout_type": "int", "age": "string"},
    )


@query
def ts_parse(spark, sf):
    log = fx.log_with_text_times(fx.prediction_log(spark, sf))
    ts = parse_timestamp("timestamp")
    return log.select("prediction_id", micros(ts).alias("micros"), date_string(ts).alias("date"))


@query
def ts_polymorphic(spark, sf):
    e = fx.events(spark, sf)
    seconds = F.unix_seconds("ts").cast("string")
    text = (
        F.when(F.col("event_id") % 5 == 0, iso_utc("ts"))
        .when(F.col("event_id") % 5 == 1, F.concat(F.lit('{"_seconds": '), seconds, F.lit("}")))
        .when(F.col("event_id") % 5 == 2, F.concat(F.lit('{"seconds": '), seconds, F.lit(', "nanos": 5}')))
        .when(F.col("event_id") % 5 == 3, "nope")
    )
    return e.select("event_id", micros(parse_any_timestamp(text)).alias("micros"))


@query
def ts_round_half_even(spark, sf):
    half = fx.shifted(truncate_to_second("ts"), F.col("event_id") % 4 * 500_000)
    return fx.events(spark, sf).select(
        "event_id", micros(round_to_second("ts")).alias("rounded"), micros(round_to_second(half)).alias("rounded_tie"),
        micros(truncate_to_second("ts")).alias("truncated"),
    )


@query
def ts_render(spark, sf):
    ts = truncate_to_second(fx.shifted("ts", F.col("event_id") * 3_600_000_000))
    return fx.events(spark, sf).select("event_id", iso_utc(ts).alias("iso"), local_string(ts).alias("madrid"))


@query
def ts_fallback(spark, sf):
    own = F.when(F.col("event_type") != "error", F.col("ts"))
    stored = F.when(F.col("event_id") % 2 == 0, fx.shifted("ts", F.lit(1_000_000)))
    return fx.events(spark, sf).select("event_id", micros(event_time(own, stored)).alias("micros"))


@query
def user_id_hash(spark, sf):
    return fx.table(spark, sf, "customer").select("c_custkey", user_id("c_name").alias("user_id"))


@query
def email_normalise(spark, sf):
    messy = F.concat(F.lit("  "), "c_name", F.lit("@Example.COM\t"))
    return fx.table(spark, sf, "customer").select("c_custkey", normalise_email(messy).alias("email"))


@query
def prediction_ids(spark, sf):
    log = fx.prediction_log(spark, sf)
    return log.select("prediction_id", prediction_id(normalise_email("email"), "timestamp").alias("new_id"))


@query
def row_error_metrics(spark, sf):
    fb = fx.feedback_log(spark, sf).filter(F.col(PREDICTED).isNotNull())
    return fb.select("email", micros("timestamp").alias("timestamp"), *[m.alias(n) for n, m in error_metrics(REAL, PREDICTED).items()])


@query
def round_prediction(spark, sf):
    return fx.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", round_half_even(F.col("l_extendedprice") / 7, 2).alias("rounded"))


@query
def coalesce_alternates(spark, sf):
    fb = fx.feedback_log(spark, sf)
    df = fb.select(
        "email", micros("timestamp").alias("timestamp"), F.when(F.col(PREDICTED).isNull(), F.col(REAL)).alias(REAL),
        (F.col(REAL) + 1).alias(f"{REAL}_feedback"), PREDICTED, (F.col(REAL) + 2).alias(f"{PREDICTED}_feedback"),
    )
    return project.coalesce_alternates(df).select("email", "timestamp", REAL, PREDICTED)


# ---- quality --------------------------------------------------------------

@query
def schema_violations(spark, sf):
    df = fx.table(spark, sf, "part")
    expected = {"p_partkey": "bigint", "p_size": "bigint", "p_name": "string", "p_weight": "double"}
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return quality.schema_violations(df, expected).withColumn("rows", rows)


CUSTOMER_RULES = (
    quality.Rule("c_acctbal", low=0, high=9000),
    quality.Rule("c_mktsegment", allowed=("MACHINERY", "BUILDING", "AUTOMOBILE", "HOUSEHOLD")),
    quality.Rule("c_name", min_length=3),
)


@query
def domain_violations(spark, sf):
    return quality.violation_counts(fx.table(spark, sf, "customer"), CUSTOMER_RULES)


@query
def domain_quarantine(spark, sf):
    _, bad = quality.split_valid(fx.table(spark, sf, "customer"), CUSTOMER_RULES)
    return bad.select("c_custkey", F.array_join("reasons", ",").alias("reasons"))


@query
def domain_feedback(spark, sf):
    """Feedback outside the domain of a feedback record, with the rules it breaks."""
    _, bad = quality.split_valid(fx.feedback_log(spark, sf), quality.FEEDBACK_RULES)
    return bad.select("email", micros("timestamp").alias("timestamp"), REAL, F.concat_ws(",", "reasons").alias("reasons"))


@query
def domain_valid_requests(spark, sf):
    valid, _ = quality.split_valid(fx.prediction_log(spark, sf), quality.REQUEST_RULES)
    return valid.select("prediction_id", "age", "experience_level")


@query
def null_profile(spark, sf):
    return quality.null_profile(fx.with_gaps(fx.training_set(spark, sf)))


@query
def drop_missing(spark, sf):
    df = quality.drop_missing(fx.with_gaps(fx.training_set(spark, sf)), ["l_tax", "l_returnflag"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("rows"), F.avg("l_tax").alias("tax"))


@query
def feedback_routing(spark, sf):
    linked, orphans = ledger.route_feedback(fx.feedback_log(spark, sf))
    named = [(linked, "linked"), (orphans, "orphan")]
    parts = [df.select("email", micros("timestamp").alias("timestamp"), REAL, F.lit(n).alias("route")) for df, n in named]
    return parts[0].unionByName(parts[1])


# ---- match ----------------------------------------------------------------

def _match_sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    return fx.prediction_log(spark, sf).select("user_id", "email", "timestamp", PREDICTED), fx.feedback_log(spark, sf).select(
        "user_id", "email", "timestamp", REAL, PREDICTED
    )


def _daily(df: DataFrame) -> DataFrame:
    """Coarse times: many rows per key on both sides, and some without a time."""
    day = F.when(F.hour("timestamp") > 0, F.date_trunc("day", "timestamp"))
    return df.withColumn("timestamp", day)


@query
def match_rows(spark, sf):
    joined = match.join_feedback(*_match_sides(spark, sf))
    return joined.select("user_id", "email", micros("timestamp").alias("timestamp"), "y_pred", "y_true")


@query
def match_rows_fan_out(spark, sf):
    pred, fb = _match_sides(spark, sf)
    sums = match.matched_sums(_daily(pred), _daily(fb), hot_rows=100)
    n = F.sum(F.col("weight") * F.col("n_pred"))
    means = {"y_pred": F.col("weight") * F.col("sum_pred"), "y_true": F.col("weight") * F.col("n_pred") * F.col("y_true")}
    return sums.groupBy("user_id").agg(n.alias("n"), *((F.sum(c) / n).alias(k) for k, c in means.items())).filter("n > 0")


@query
def monitor_join_metrics(spark, sf):
    return monitoring.match_metrics(*_match_sides(spark, sf)).select(
        "n", "mae", "rmse", "bias", "mean_signed_error", "mean_relative_error", "r2"
    )


@query
def monitor_join_metrics_fan_out(spark, sf):
    pred, fb = _match_sides(spark, sf)
    return monitoring.match_metrics(_daily(pred), _daily(fb), hot_rows=100).select("n", "mae", "rmse", "bias", "r2")


@query
def monitor_metrics_of_feedback(spark, sf):
    """The prediction stored with the feedback counts where there is one."""
    return monitoring.match_metrics(*_match_sides(spark, sf), prefer_feedback_prediction=True).select(
        "n", "mae", "rmse", "bias", "mean_signed_error", "mean_relative_error", "r2"
    )


def _coarse(df: DataFrame) -> DataFrame:
    """Three groups of users by month: every key holds a third of the rows."""
    group = F.concat(F.lit("group"), (F.col("user_id").cast("int") % 3).cast("string"))
    return df.withColumns({"user_id": F.lit("user"), "email": group, "timestamp": F.date_trunc("month", "timestamp")})


@query
def monitor_metrics_hot_keys(spark, sf):
    pred, fb = _match_sides(spark, sf)
    return monitoring.match_metrics(_coarse(pred), _coarse(fb), hot_rows=100).select("n", "mae", "rmse", "bias", "r2")


@query
def hot_match_keys(spark, sf):
    """The keys above the limit of the query before: its split branch is not empty."""
    pred, fb = _match_sides(spark, sf)
    keys = list(match.MATCH_KEYS)
    rows = _coarse(pred).select(*keys).unionByName(_coarse(fb).filter(F.col(REAL).isNotNull()).select(*keys))
    counts = rows.groupBy("email", "timestamp", hot.key_hash(keys).alias(hot.HOT)).agg(F.count(F.lit(1)).alias("rows"))
    named = counts.join(hot.hot_keys(rows, keys, 100).select(hot.HOT), hot.HOT)
    return named.select("email", micros("timestamp").alias("timestamp"), "rows")


@query
def monitor_metrics_large_values(spark, sf):
    """Values far from 0 that lie close together keep their digits."""
    line, orders = fx.table(spark, sf, "lineitem"), fx.table(spark, sf, "orders")
    pred = line.select(F.col("l_orderkey").alias("user_id"), F.lit("a").alias("email"), (F.col("l_extendedprice") + 1e6).alias(PREDICTED))
    fb = orders.select(F.col("o_orderkey").alias("user_id"), F.lit("a").alias("email"), (F.col("o_totalprice") / 4 + 1e6).alias(REAL))
    m = monitoring.match_metrics(pred, fb)
    return m.select("n", *((F.col(c) / 1000).alias(f"{c}_k") for c in ("mae", "rmse", "bias")), "r2")


@query
def top_users_by_mae(spark, sf):
    pred, fb = _match_sides(spark, sf)
    return monitoring.worst_matched_users(_daily(pred), _daily(fb))


@query
def duplicate_match_keys(spark, sf):
    pred, _ = _match_sides(spark, sf)
    return match.duplicate_keys(_daily(pred), list(match.MATCH_KEYS)).withColumn("timestamp", micros("timestamp"))


# ---- aggregates -----------------------------------------------------------

def _patched(spark, sf) -> DataFrame:
    base = fx.prediction_log(spark, sf).select("prediction_id", "email", "timestamp", PREDICTED)
    return ledger.merge_patches(base, ledger.fold_patches(ledger.patches_from_feedback(fx.repeated_feedback(spark, sf))))


@query
def error_summary(spark, sf):
    return metrics.error_summary(project.coalesce_alternates(_patched(spark, sf)))


@query
def error_summary_one_user(spark, sf):
    log = project.coalesce_alternates(_patched(spark, sf)).withColumn("email", normalise_email("email"))
    return metrics.error_summary_for(log, " USER42@example.com")


@query
def error_summary_by_user(spark, sf):
    return metrics.error_summary(project.coalesce_alternates(_patched(spark, sf)), by=["email"])


@query
def regression_metrics_r2(spark, sf):
    df = fx.table(spark, sf, "lineitem").withColumn("guess", 2100 * F.col("l_quantity") + 5 * F.col("l_linenumber"))
    return metrics.regression_metrics(df, "l_extendedprice", "guess", by=["l_returnflag", "l_linestatus"], places=None).select(
        "l_returnflag", "l_linestatus", "n", (F.col("mae") / 1000).alias("mae_k"), (F.col("rmse") / 1000).alias("rmse_k"), "r2"
    )


@query
def train_test_metrics(spark, sf):
    """Metrics per split of a closed-form model on the training set."""
    df = split.split_bucket(fx.training_set(spark, sf), fx.KEY)
    guess = 10 + 5 * F.ln("l_quantity") + 40 * F.col("l_discount")
    return forest.split_metrics(df.withColumn("prediction", guess), fx.LABEL)


@query
def bias_metrics(spark, sf):
    return metrics.bias_metrics(fx.feedback_log(spark, sf), REAL, PREDICTED)


@query
def user_errors_top(spark, sf):
    per_user = metrics.user_errors(fx.feedback_log(spark, sf), REAL, PREDICTED)
    return metrics.worst_users(per_user)


@query
def drift_report(spark, sf):
    e = fx.events(spark, sf).select(
        F.col("ts").alias("timestamp"), "value", F.length("props").alias("props_length"),
        F.ln("value").alias("ln_value"), F.log1p("value").alias("log1p_value"),
    )
    return drift.drift_report(e, ["value", "props_length", "ln_value", "log1p_value", "absent"])


@query
def overview_counters(spark, sf):
    return drift.overview(fx.prediction_log(spark, sf), fx.feedback_log(spark, sf))


@query
def describe_numeric(spark, sf):
    return profile.describe(fx.table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_linenumber", "l_suppkey"])


@query
def quantiles(spark, sf):
    return order_stats.exact_quantiles(fx.table(spark, sf, "orders"), ["o_totalprice", "o_custkey"], [0.01, 0.5, 0.9, 0.999])


@query
def table_profile(spark, sf):
    return profile.table_profile(fx.with_gaps(fx.training_set(spark, sf)))


@query
def histogram(spark, sf):
    return profile.histogram(fx.table(spark, sf, "part"), "p_retailprice", 16)


@query
def histogram_sparse(spark, sf):
    """A long tail: its bins stay, most with no rows."""
    values = fx.table(spark, sf, "customer").select(F.col("c_acctbal").alias("v"))
    for _ in range(5):
        values = values.select((F.col("v") * F.col("v")).alias("v"))
    return profile.histogram(values, "v", 200).select("bin", "rows")


@query
def empty_reports(spark, sf):
    """Every report over tables in which no row is left: none has a row."""
    pred, fb = (df.filter("user_id IS NULL") for df in _match_sides(spark, sf))
    named = {
        "error_summary": metrics.error_summary(fb), "regression_metrics": metrics.regression_metrics(fb, REAL, PREDICTED),
        "match_metrics": monitoring.match_metrics(pred, fb), "worst_users": monitoring.worst_matched_users(pred, fb),
        "histogram": profile.histogram(pred, PREDICTED), "describe": profile.describe(pred, [PREDICTED]),
    }
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("report"), "rows") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts)


@query
def match_two_keys(spark, sf):
    """Sides that share two of the three keys are matched on these."""
    day = F.date_trunc("day", "timestamp")
    pred, fb = (df.drop("email").withColumn("timestamp", day) for df in _match_sides(spark, sf))
    found = metrics.matched_metrics(match.matched_sums(pred, fb), by=["user_id", "timestamp"])
    return found.select("user_id", micros("timestamp").alias("timestamp"), "n", "mae")


@query
def pair_grid(spark, sf):
    """Joint distributions of all pairs of numeric columns."""
    return profile.pair_grid(fx.table(spark, sf, "part"), ["p_partkey", "p_size", "p_retailprice"], 8)


@query
def pair_grid_lines(spark, sf):
    lines = fx.table(spark, sf, "lineitem")
    return profile.pair_grid(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 10).select("x_name", "y_name", "x_bin", "y_bin", "rows")


@query
def pair_points(spark, sf):
    return profile.pair_sample(fx.table(spark, sf, "part"), ["p_size", "p_retailprice"], "p_partkey", 200)


@query
def label_range(spark, sf):
    return profile.value_range(fx.feedback_log(spark, sf), [REAL, PREDICTED], by=["user_id"])


# ---- ledger ---------------------------------------------------------------

@query
def latest_per_key(spark, sf):
    orders = fx.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus")
    return ledger.latest_per_key(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query
def feedback_patch_merge(spark, sf):
    out = _patched(spark, sf)
    return out.withColumns({"timestamp": micros("timestamp"), "feedback_timestamp": micros("feedback_timestamp")})


@query
def history_asc(spark, sf):
    df = _patched(spark, sf).filter("email is not null")
    return ledger.history(df).select("prediction_id", "email", "timestamp", f"{PREDICTED}_number", f"{REAL}_number")


@query
def history_one_user(spark, sf):
    df = fx.prediction_log(spark, sf).withColumn("email", normalise_email("email"))
    return ledger.history(df, "User3@Example.com ").select("prediction_id", "timestamp", f"{PREDICTED}_number")


@query
def history_desc(spark, sf):
    df = fx.log_with_text_times(fx.prediction_log(spark, sf))
    return ledger.history_table(df).select("timestamp", PREDICTED, "weight_kg", "workout_type", "avg_bpm", "height_m")


@query
def latest_ten(spark, sf):
    return ledger.latest_predictions(fx.prediction_log(spark, sf)).select("prediction_id", "email", PREDICTED)


@query
def head_rows(spark, sf):
    return profile.head(fx.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice"), 5, F.desc("o_totalprice"), "o_orderkey")


@query
def training_rows(spark, sf):
    return ledger.training_rows(_patched(spark, sf)).select("prediction_id", REAL, PREDICTED)


@query
def plain_lookup(spark, sf):
    df = fx.prediction_log(spark, sf).withColumn("email", F.lower("email"))
    return ledger.lookup(df, "User12@Example.com").select("doc_id", "email", PREDICTED)


@query
def series_long(spark, sf):
    fb = fx.feedback_log(spark, sf)
    return ledger.series_long(fb).select(micros("timestamp").alias("timestamp"), "serie", "value")


# ---- preparation ----------------------------------------------------------

@query
def standard_scale(spark, sf):
    df = fx.table(spark, sf, "part").withColumn("constant", F.lit(7))
    return prep.standard_scale(df, ["p_size", "p_retailprice", "constant"]).select(
        "p_partkey", "p_size_scaled", "p_retailprice_scaled", "constant_scaled"
    )


@query
def one_hot_wide(spark, sf):
    df = fx.with_gaps(fx.training_set(spark, sf))
    wide = prep.one_hot_wide(df, fx.CATEGORICAL)
    return wide.select(fx.KEY, "l_returnflag_A", "l_returnflag_N", "l_returnflag_R", "l_linestatus_F", "l_linestatus_O")


@query
def prepared_vector(spark, sf):
    """Fitted column transformer: scaled numbers, then one-hot columns."""
    df = fx.with_gaps(fx.training_set(spark, sf))
    out, _ = prep.fit_transform(df, ["l_quantity", "l_discount"], ["l_returnflag"])
    v = vector_to_array("features")
    names = ["l_quantity", "l_discount", "flag_a", "flag_n", "flag_r"]
    return out.select(fx.KEY, *[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(names)])


@query
def prepared_vector_reloaded(spark, sf):
    """The fitted preparation saved as an artifact, loaded and applied."""
    df, root = fx.with_gaps(fx.training_set(spark, sf)), scratch_dir(spark, "models")
    _, model = prep.fit_transform(df, ["l_quantity", "l_discount"], ["l_returnflag"])
    save_preparation(model, root)
    v = vector_to_array("features")
    names = ["l_quantity", "l_discount", "flag_a", "flag_n", "flag_r"]
    out = load_preparation(spark, root).transform(df)
    return out.select(fx.KEY, *[F.get(v, F.lit(i)).alias(n) for i, n in enumerate(names)])


@query
def wide_feature_table(spark, sf):
    return prep.feature_table(fx.table(spark, sf, "customer"), ["c_acctbal"], ["c_mktsegment"], ["c_custkey"])


@query
def impute_median_mode(spark, sf):
    df = prep.impute(fx.with_gaps(fx.training_set(spark, sf)), ["l_tax"], ["l_returnflag"])
    return df.select(fx.KEY, "l_tax", "l_returnflag")


@query
def split_exact(spark, sf):
    return split.split_exact(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def split_bucket(spark, sf):
    return split.split_bucket(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey")


@query
def folds_contiguous(spark, sf):
    return split.contiguous_folds(fx.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 7)


# ---- models ---------------------------------------------------------------

def _training(spark, sf) -> DataFrame:
    """The training set, written once: fitting and scoring read it several times."""
    return stored(fx.training_set(spark, sf), "training")


def _fitted(spark, sf, **kwargs):
    df = _training(spark, sf).drop("l_partkey", "l_suppkey")
    return df, *training.train(df, fx.LABEL, fx.KEY, **{**MODEL, **kwargs})


def _good(r2: str = "r2") -> F.Column:
    """What holds of any sound fit: the noise of the label leaves an R2 of 0.97 within reach."""
    return (F.col(r2) >= 0.8).alias("good")


@query
def forest_fit(spark, sf):
    df, model, _ = _fitted(spark, sf)
    found = forest.split_metrics(model.transform(split.split_bucket(df, fx.KEY)), fx.LABEL)
    return found.select("split", "n", _good())


@query
def numeric_baseline(spark, sf):
    df = _training(spark, sf)
    model = forest.fit_numeric_baseline(df, fx.LABEL, ["l_quantity", "l_discount", "l_tax"], fit_rows=5_000, partitions=8)
    return metrics.regression_metrics(model.transform(df), fx.LABEL, "prediction").select("n", _good())


@query
def cv_mean_r2(spark, sf):
    df = split.hash_folds(fx.training_set(spark, sf), fx.KEY)
    scores = forest.cross_validate(df, fx.LABEL, [{"trees": 10}], fx.NUMERIC, fx.CATEGORICAL)
    return scores.select("trial", "fold", "n", _good())


@query
def cv_contiguous(spark, sf):
    """Cross-validation over contiguous folds in the order of a key."""
    place = F.split(fx.KEY, "-")
    df = fx.training_set(spark, sf).withColumn("place", place[0].cast("bigint") * 10 + place[1].cast("bigint"))
    # Which row of a place stays is open, and several passes follow: written once.
    df = split.contiguous_folds(stored(df.dropDuplicates(["place"]), "places"), "place", 3)
    scores = forest.cross_validate(df, fx.LABEL, [{"trees": 10}], fx.NUMERIC, fx.CATEGORICAL)
    return scores.select("trial", "fold", "n", _good())


@query
def search_trials(spark, sf):
    """The first two draws, and each with half its trees and 10 rows per split out of the same fits; three folds, every row scored by each."""
    df = split.hash_folds(fx.training_set(spark, sf), fx.KEY)
    trials = forest.random_trials()[:2]
    trials += [{**t, "trees": t["trees"] // 2, "min_split": 10} for t in trials]
    table, best = forest.search(df, fx.LABEL, fx.NUMERIC, fx.CATEGORICAL, trials=trials, parallelism=3)
    top = table.agg(F.max("mean_r2")).scalar()
    drawn = [F.element_at("params", name).cast("int").alias(name) for name in ("trees", "depth", "min_split", "min_leaf")]
    chosen = F.element_at("params", "trees") == best["trees"]
    return table.select("trial", *drawn, "n", (~chosen | (F.col("mean_r2") == top)).alias("best_is_top"), (F.col("mean_r2") >= 0.5).alias("good"))


@query
def tune_and_refit(spark, sf):
    df = _training(spark, sf).drop("l_partkey", "l_suppkey")
    trials = [{"trees": 10, "depth": 3, "min_leaf": 1}, {"trees": 10, "depth": 20, "min_leaf": 1}]
    table, best, model = training.tune(
        df, fx.LABEL, fx.KEY, trials=trials, model_root=scratch_dir(spark, "models")
    )
    found = metrics.regression_metrics(model.transform(df), fx.LABEL, "prediction")
    return found.select("n", F.lit(best["depth"]).alias("best_depth"), _good())


@query
def training_report(spark, sf):
    df = fx.training_set(spark, sf).drop("l_partkey", "l_suppkey")
    path = scratch_dir(spark, "report")
    training.train_and_report(df, fx.LABEL, fx.KEY, scratch_dir(spark, "models"), path, **MODEL)
    fields = "target string, n_rows bigint, n_features_before int, metrics map<string, struct<n: bigint, mae: double, rmse: double, r2: double>>"
    return spark.read.schema(fields).json(path).select("target", "n_rows", "n_features_before", F.explode("metrics").alias("split", "m")).select(
        "target", "n_rows", "n_features_before", "split", "m.n", _good("m.r2")
    )


def _registered(spark, sf) -> tuple[DataFrame, ModelRegistry]:
    df = fx.with_gaps(_training(spark, sf)).drop("l_partkey", "l_suppkey")
    registry = ModelRegistry(spark, scratch_dir(spark, "registry"))
    training.train_or_register(df, registry, "forest", fx.KEY, target=fx.LABEL, **MODEL)
    return df, registry


@query
def register_and_load(spark, sf):
    """A trained version, then one without labels, whose metrics are unknown (-1)."""
    df, registry = _registered(spark, sf)
    model, _ = registry.latest("forest")
    training.train_or_register(df.drop(fx.LABEL), registry, "forest", fx.KEY, fallback=model, target=fx.LABEL)
    mae, r2 = (F.element_at("metrics", m) for m in ("mae", "r2"))
    return registry.entries("forest").select("version", (mae == -1).alias("unknown"), (r2 >= 0.8).alias("good"))


@query
def batch_score(spark, sf):
    """Latest registered model over a whole feature table, into the output table."""
    df, registry = _registered(spark, sf)
    root = scratch_dir(spark, "groups")
    spec = groups.TableSpec("lines", 1, ("user_id", "email"), "timestamp", None, 16)
    digest = F.conv(F.substring(F.md5(F.concat(F.lit("42:"), F.col(fx.KEY))), 1, 8), 16, 10).cast("bigint")
    rows = df.drop(fx.LABEL).withColumns({
        "user_id": user_id(fx.KEY), "email": F.col(fx.KEY),
        "timestamp": F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((digest % 28).cast("int")),
    })
    groups.insert(spark, root, spec, rows)
    found = scoring.batch_inference(spark, root, registry, "forest", spec)
    low, high = (df.agg(f(fx.LABEL)).scalar() for f in (F.min, F.max))
    return found.select("user_id", "email", micros("timestamp").alias("timestamp"), F.col(PREDICTED).between(low, high).alias("in_range"))


def _request_model(spark, sf):
    """A forest over every field of a request."""
    log = project.build_features(fx.prediction_log(spark, sf)).withColumn("experience_level", to_int("experience_level"))
    labelled = log.withColumn(fx.LABEL, 5 + F.col("bmi") / 2 + F.col("age") / 10)
    numeric = [c for c in FEATURE_FIELDS if c not in ("gender", "workout_type")]
    model = forest.fit_forest(labelled, fx.LABEL, numeric, ["gender", "workout_type"], **MODEL)
    return model, *(labelled.agg(f(fx.LABEL)).scalar() for f in (F.min, F.max))


def _scored(df: DataFrame, low, high) -> DataFrame:
    p = F.col(PREDICTED)
    return df.select(
        "prediction_id", "email", micros("timestamp").alias("timestamp"), p.between(low - 0.01, high + 0.01).alias("in_range"),
        (F.rint(p * 100) / 100 == p).alias("two_places"), "bmi",
    )


@query
def score_records(spark, sf):
    model, low, high = _request_model(spark, sf)
    return _scored(scoring.score_records(fx.prediction_log(spark, sf), model), low, high)


@query
def model_compare(spark, sf):
    """Two forests by their error: the one of depth 3 comes second."""
    df, small, _ = _fitted(spark, sf, trees=2, depth=3)
    _, large, _ = _fitted(spark, sf)
    test = split.split_bucket(df, fx.KEY).filter("split = 'test'")
    found = scoring.compare_models(test, {"small": small, "large": large}, fx.LABEL, fx.KEY)
    best = found.agg(F.min("rmse")).scalar()
    return found.select("model", "n", (F.col("rmse") == best).alias("best"))


# ---- streams --------------------------------------------------------------

def _streamed(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Requests as a file stream: (scored rows, requests set aside)."""
    inbox, out, bad = (scratch_dir(spark, name) for name in ("requests", "scored", "quarantine"))
    fx.prediction_log(spark, sf).drop("prediction_id", "user_id", PREDICTED).write.option("timestampFormat", JSON_TIME).json(inbox)
    model, low, high = _request_model(spark, sf)
    requests = read_requests(spark, inbox)
    for stream in score_stream(requests, model, out, scratch_dir(spark, "cp"), bad):
        stream.awaitTermination()  # ends by itself once the files are read
    return _scored(spark.read.parquet(out), low, high), spark.read.parquet(bad)


@query
def stream_score(spark, sf):
    """Requests as a file stream; invalid ones are set aside, the rest scored."""
    return _streamed(spark, sf)[0]


@query
def stream_score_routes(spark, sf):
    """No request is lost: those scored and those set aside are all there were."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).withColumn("route", F.lit(name)) for df, name in zip(_streamed(spark, sf), ("scored", "set aside"))]
    return parts[0].unionByName(parts[1])


def _applied(spark, sf) -> tuple[LedgerSnapshot, str]:
    inbox, orphans = scratch_dir(spark, "feedback"), scratch_dir(spark, "orphans")
    fx.repeated_feedback(spark, sf).drop("user_id").repartition(6).write.option("timestampFormat", JSON_TIME).json(inbox)
    snapshot = LedgerSnapshot(spark, scratch_dir(spark, "ledger"), buckets=8)
    log = fx.prediction_log(spark, sf).select("prediction_id", "email", "timestamp", PREDICTED)
    snapshot.create(log, ["timestamp"])
    feedback = read_feedback(spark, inbox, files_per_trigger=3)
    apply_feedback_stream(feedback, snapshot, scratch_dir(spark, "cp"), orphans).awaitTermination()
    return snapshot, orphans


@query
def stream_feedback(spark, sf):
    """Feedback files folded into the snapshot in several micro-batches."""
    snapshot, _ = _applied(spark, sf)
    return snapshot.read().withColumns({"timestamp": micros("timestamp"), "feedback_timestamp": micros("feedback_timestamp")})


@query
def stream_feedback_orphans(spark, sf):
    """Feedback that names no prediction, kept beside the snapshot."""
    _, orphans = _applied(spark, sf)
    return spark.read.parquet(orphans).select("email", micros("timestamp").alias("timestamp"), REAL)


def _replayed(spark, start, checkpoint: str) -> None:
    """Run a query to its end, then once more as after a failure in its last batch."""
    start().awaitTermination()
    last = max(child_files(spark, f"{checkpoint}/commits"), key=int)
    delete(spark, f"{checkpoint}/commits/{last}")
    start().awaitTermination()


def _log_stream(spark, df: DataFrame, files: int = 6):
    """Log rows as text in files, read a few files a batch."""
    inbox = scratch_dir(spark, "log")
    df.repartition(files).write.json(inbox)
    return lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).json(inbox)


@query
def stream_sync_predictions(spark, sf):
    """The prediction log into its table in micro-batches, the last one run twice."""
    read = _log_stream(spark, fx.log_with_text_times(fx.prediction_log(spark, sf)).drop("user_id"))
    root, checkpoint = scratch_dir(spark, "groups"), scratch_dir(spark, "cp")
    spec = replace(groups.PREDICTION_GROUP, primary_key=("user_id", "email", "prediction_id"))
    _replayed(spark, lambda: sync_prediction_stream(read(), root, checkpoint, spec), checkpoint)
    return groups.read_group(spark, root, spec.name).select(
        "prediction_id", "user_id", micros("timestamp").alias("timestamp"), "date", "experience_level", REAL, "bmi", "log_age"
    )


@query
def stream_sync_feedback(spark, sf):
    """The feedback log likewise, one row per user and time as text."""
    log = fx.log_with_text_times(fx.feedback_log(spark, sf)).drop("user_id")
    read = _log_stream(spark, log.groupBy("email", "timestamp").agg(F.max_by(REAL, "prediction_id").alias(REAL), F.max("prediction_id").alias("prediction_id")))
    root, checkpoint = scratch_dir(spark, "groups"), scratch_dir(spark, "cp")
    _replayed(spark, lambda: sync_feedback_stream(read(), root, checkpoint), checkpoint)
    return groups.read_group(spark, root, groups.FEEDBACK_GROUP.name).select(
        "email", "user_id", micros("timestamp").alias("timestamp"), "date", "prediction_id"
    )


@query
def stream_score_distinct(spark, sf):
    """A source that delivers every request twice and some three times: each is scored once."""
    inbox, out, bad = (scratch_dir(spark, name) for name in ("requests", "scored", "quarantine"))
    log = fx.prediction_log(spark, sf).drop("prediction_id", "user_id", PREDICTED)
    again = log.unionByName(log).unionByName(log.filter("age % 2 = 0"))
    again.repartition(6).write.option("timestampFormat", JSON_TIME).json(inbox)
    model, low, high = _request_model(spark, sf)
    requests = read_requests(spark, inbox, files_per_trigger=3)
    # Repeats of a request may come with any other of the log: nothing is late within its span.
    for stream in score_stream(requests, model, out, scratch_dir(spark, "cp"), bad, distinct_within="4000 days"):
        stream.awaitTermination()
    return _scored(spark.read.parquet(out), low, high).select("prediction_id", "email", "timestamp", "in_range", "two_places")


@query
def stream_feedback_distinct(spark, sf):
    """A feedback source that repeats rows: broken ones are set aside once, the others patch once."""
    inbox, orphans, bad = (scratch_dir(spark, name) for name in ("feedback", "orphans", "bad"))
    log = fx.feedback_log(spark, sf).drop("user_id")
    log.unionByName(log).repartition(6).write.option("timestampFormat", JSON_TIME).json(inbox)
    snapshot = LedgerSnapshot(spark, scratch_dir(spark, "ledger"), buckets=8, compact_after=2)
    snapshot.create(fx.prediction_log(spark, sf).select("prediction_id", "email", "timestamp", PREDICTED), ["timestamp"])
    checkpoint = scratch_dir(spark, "cp")
    _replayed(
        spark,
        lambda: apply_feedback_stream(read_feedback(spark, inbox, files_per_trigger=3), snapshot, checkpoint, orphans, bad, "4000 days"),
        checkpoint,
    )
    patched = snapshot.read().filter(F.col(REAL).isNotNull())
    parts = {"patched": patched, "orphan": spark.read.parquet(orphans), "broken": spark.read.parquet(bad)}
    return reduce(DataFrame.unionByName, [
        df.agg(F.count("*").alias("rows"), F.sum(REAL).alias("total")).withColumn("route", F.lit(name)) for name, df in parts.items()
    ])
