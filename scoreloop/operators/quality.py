"""Schema checks, row domain checks and null handling."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# ---- schema ---------------------------------------------------------------

def schema_violations(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """One row per missing column or wrong type; empty when the schema fits."""
    actual = dict(df.dtypes)
    rows = [
        (name, want, actual.get(name), "missing" if name not in actual else "wrong_type")
        for name, want in expected.items()
        if actual.get(name) != want
    ]
    schema = "column string, expected string, actual string, problem string"
    return df.sparkSession.createDataFrame(rows, schema)


def require_schema(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Return ``df`` unchanged, or raise one error naming every violation."""
    actual = dict(df.dtypes)
    problems = [
        f"missing column: {c}" if c not in actual else f"wrong type in {c}: expected {t}, got {actual[c]}"
        for c, t in expected.items()
        if actual.get(c) != t
    ]
    if problems:
        raise ValueError("\n".join(problems))
    return df


# ---- row domains ----------------------------------------------------------

@dataclass(frozen=True)
class Rule:
    """A named domain: a closed value set, a numeric range, or a text length."""

    column: str
    allowed: tuple = ()
    low: float | None = None
    high: float | None = None
    whole: bool = False
    min_length: int | None = None

    @property
    def name(self) -> str:
        return f"{self.column}_domain"

    def holds(self) -> Column:
        raw = F.col(f"`{self.column}`")
        if self.min_length is not None:
            test = F.length(raw) >= self.min_length
        elif self.allowed:
            test = raw.cast("string").isin([str(v) for v in self.allowed])
        else:
            number = raw.try_cast("double")
            test = number.between(self.low, self.high)
            if self.whole:
                test = test & (number == F.floor(number))
        return F.coalesce(test, F.lit(False))

    def admits(self, value: object) -> bool:
        """The same test for one value, such as an argument of a lookup."""
        if value is None:
            return False
        if self.min_length is not None:
            return len(str(value)) >= self.min_length
        if self.allowed:
            return str(value) in {str(v) for v in self.allowed}
        try:
            number = float(value)
        except (TypeError, ValueError):
            return False
        return self.low <= number <= self.high and (not self.whole or number.is_integer())


# The domains of a scoring request.
REQUEST_RULES = (
    Rule("email", min_length=1),
    Rule("age", low=10, high=100, whole=True),
    Rule("gender", allowed=("Male", "Female")),
    Rule("weight_kg", low=30, high=200),
    Rule("height_m", low=1.2, high=2.2),
    Rule("max_bpm", low=80, high=220, whole=True),
    Rule("avg_bpm", low=60, high=200, whole=True),
    Rule("resting_bpm", low=30, high=120, whole=True),
    Rule("session_duration_hours", low=0.1, high=4),
    Rule("calories_burned", low=0, high=5000),
    Rule("workout_type", allowed=("Cardio", "Strength", "Mixed")),
    Rule("water_intake_liters", low=0, high=10),
    Rule("workout_frequency_days_week", low=1, high=7, whole=True),
    Rule("experience_level", allowed=(1, 2, 3)),
)

# The domain of a feedback record and of a history lookup.
FEEDBACK_RULES = (Rule("email", min_length=1), Rule("real_fat_percentage", low=1, high=80))
LOOKUP_RULES = (Rule("email", min_length=3),)


def with_reasons(df: DataFrame, rules: Iterable[Rule], out: str = "reasons") -> DataFrame:
    """Add the array of violated rule names (empty for a valid row)."""
    marks = [F.when(~r.holds(), F.lit(r.name)) for r in rules]
    return df.withColumn(out, F.array_compact(F.array(*marks)))


def require_valid(values: Mapping[str, object], rules: Iterable[Rule]) -> None:
    """Raise one error naming every rule that these arguments break."""
    broken = [r.name for r in rules if not r.admits(values.get(r.column))]
    if broken:
        raise ValueError(", ".join(broken))


def split_valid(df: DataFrame, rules: Iterable[Rule]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantine with reasons)."""
    marked = with_reasons(df, rules)
    return (
        marked.filter(F.size("reasons") == 0).drop("reasons"),
        marked.filter(F.size("reasons") > 0),
    )


def violation_counts(df: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Rows violating each rule, counted in one pass over the table."""
    rules = list(rules)
    counts = df.agg(*[F.count_if(~r.holds()).alias(r.name) for r in rules])
    return counts.unpivot([], [r.name for r in rules], "rule", "violations")


# ---- nulls ----------------------------------------------------------------

def null_profile(df: DataFrame) -> DataFrame:
    """Null count per column, only the columns that have any."""
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "column", "nulls").filter("nulls > 0")


def drop_missing(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Rows where all the listed columns are present."""
    return df.dropna(subset=list(columns))


def nonempty(aggregated: DataFrame, count_column: str) -> DataFrame:
    """No input rows, no result row: drop aggregate rows that counted nothing."""
    return aggregated.filter(F.col(count_column) > 0)
