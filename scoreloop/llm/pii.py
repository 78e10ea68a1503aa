"""Personal data: fixed patterns, plus spans that boosted trees pick among loose candidates.

Base spans come from one pattern per kind and a check. Their search is leftmost and never
retried, so a match that swallows a neighbour and then fails its check hides what it holds.
Looser generators propose further, overlapping spans (single tokens, usual groupings, spelled
out addresses). Boosted trees learn from the corpus itself which of those look like base spans:
a candidate that equals a base span is a positive, one that touches none is unlabelled. As
some unlabelled ones are real, scores are calibrated by the mean score of known positives held
out of the fit, and a candidate is taken from a calibrated probability of one half.

Everything is a Spark SQL function or an MLlib stage; candidates are found by ``split`` and
``regexp_extract_all`` with the same pattern, whose pieces alternate, and get their offsets from
running sums of lengths.
"""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import row_key, stored

# The kinds in their order.
KINDS = ("email", "ip", "card", "phone")
# Labelled candidates that a fit takes at most, in an order drawn by hash.
FIT_ROWS = 20_000
# Characters of context on either side of a candidate.
CONTEXT = 24

# The base patterns. Repeats at the end are possessive and starts lie at the
# beginning of a run, which changes no match but keeps long runs linear.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Looser generators, each with its kind.
LOOSE = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@| ?\(at\) ?| ?\[at\] ?)[A-Za-z0-9-]++(?:(?:\.| ?\(dot\) ?| ?\[dot\] ?)[A-Za-z0-9-]++){1,9}"),
    ("ip", r"(?<![0-9])(?<![0-9]\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])(?!\.[0-9])"),
    ("card", r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    ("card", r"(?<![0-9])[0-9]{4}(?:[ .-][0-9]{4}){3}(?![0-9])"),
    ("phone", r"(?<![0-9+])\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9])"),
)
# What a text must hold for a pattern of the kind to be worth running.
HINT = {"email": "@|\\(at\\)|\\[at\\]", "ip": r"[0-9]\.[0-9]", "card": "[0-9]", "phone": r"[0-9]"}
FEATURES = (
    "generator length digits luhn octets letters spaces dashes dots parens plus at tail before_kind after_kind cue words"
).split()


def _luhn(digits: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn check."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        x = F.substring(digits, n - i + 1, F.lit(1)).cast("int")
        twice = x * 2 - F.when(x > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(x)

    fits = n.between(12, 19)
    total = F.aggregate(F.sequence(F.lit(1), F.when(fits, n).otherwise(1)), F.lit(0), add)
    return fits & (total % 10 == 0)


def _octets(match: Column) -> Column:
    """Whether a match is four dotted numbers of at most 255."""
    parts = F.transform(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
    small = F.forall(parts, lambda p: (F.length(p) <= 3) & (F.coalesce(p.try_cast("int"), F.lit(999)) <= 255))
    return (F.size(parts) == 4) & small


def _side(text: Column) -> Column:
    """What kind of character: 0 none, 1 space, 2 letter, 3 digit, 4 other."""
    return (
        F.when(F.length(text) == 0, 0).when(text.rlike(r"^\s"), 1).when(text.rlike(r"^\p{L}"), 2).when(text.rlike("^[0-9]"), 3).otherwise(4)
    )


def candidates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """All spans that a generator proposes, as a stored table; a row without one keeps a row.

    Columns: ``rid`` (a row of ``docs``), ``key``, two hashes of the text, ``kind`` (its place in
    KINDS), ``start, end`` (code points, end exclusive), ``base`` (a base span that passed its
    check), ``same`` and ``touches`` (equals, overlaps such a span of its kind), the features.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(row_key().alias("rid"), F.col(key).alias("key"), whole.alias("text"))
    generators = [(kind, BASE[kind], True) for kind in KINDS] + [(kind, pattern, False) for kind, pattern in LOOSE]

    def found(number: int, kind: str, pattern: str) -> Column:
        hint = F.contains("text", F.lit("+")) if kind == "phone" and r"\+[0-9]" in pattern else F.col("text").rlike(HINT[kind])
        hits = F.when(hint, F.regexp_extract_all("text", F.lit(pattern), F.lit(0)))
        gaps = F.when(hint, F.split("text", pattern, -1))
        return F.struct(F.lit(number).alias("g"), hits.alias("hits"), gaps.alias("gaps"))

    every = F.array(*(found(n, kind, pattern) for n, (kind, pattern, _) in enumerate(generators)))
    hashes = F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")
    some = rows.select("rid", "key", *hashes, F.explode_outer(F.filter(every, lambda f: F.size(f["hits"]) > 0)).alias("f"))
    # Gap i, match i, gap i + 1: the last gap of a text has no match and is dropped.
    parts = F.arrays_zip(F.col("f.hits").alias("hit"), F.col("f.gaps").alias("gap"), F.slice(F.col("f.gaps"), F.lit(2), F.greatest(F.size("f.gaps"), F.lit(1))).alias("next"))
    each = some.select("rid", "key", "h1", "h2", "f.g", F.posexplode_outer(parts).alias("i", "p"))
    each = each.filter("p IS NULL OR p.hit IS NOT NULL").select(
        "rid", "key", "h1", "h2", "g", "i", F.col("p.hit").alias("hit"), F.length("p.gap").alias("gap"),
        F.right(F.col("p.gap"), F.lit(CONTEXT)).alias("before"), F.left(F.col("p.next"), F.lit(CONTEXT)).alias("after"),
    )
    dealt = each.repartition("rid")
    run = Window.partitionBy("rid", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.length("hit")).over(run)
    digits = F.regexp_replace("hit", "[^0-9]", "")
    kinds = F.element_at(F.array(*(F.lit(KINDS.index(k)) for k, _, _ in generators)), F.col("g") + 1)
    placed = dealt.select(
        "*", kinds.alias("kind"), end.alias("end"), (end - F.length("hit")).alias("start"), (F.col("g") < len(KINDS)).alias("strict"), digits.alias("number")
    )
    checks = placed.withColumns({"luhn": _luhn(F.col("number")), "octets": _octets(F.col("hit"))})
    passes = (
        F.when(F.col("kind") == 0, True).when(F.col("kind") == 1, F.col("octets"))
        .when(F.col("kind") == 2, F.col("luhn")).otherwise(F.length("number").between(9, 15))
    )
    checks = checks.withColumn("base", F.col("strict") & passes)
    by = Window.partitionBy("rid", "kind").orderBy("start")
    reach = F.max(F.when(F.col("base"), F.col("end"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    ahead = F.min(F.when(F.col("base"), F.col("start"))).over(by.rangeBetween(0, Window.unboundedFollowing))
    equal = F.max("base").over(Window.partitionBy("rid", "kind", "start", "end"))
    touched = F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(ahead < F.col("end"), F.lit(False))
    known = checks.withColumns({"same": equal, "touches": touched})

    # No feature tells of digits close by: that is what hides spans from the base patterns,
    # so trees that saw it would learn the patterns' search instead of the spans' form.
    def many(pattern: str) -> Column:
        return F.length("hit") - F.length(F.regexp_replace("hit", pattern, ""))

    shape = {
        "generator": F.col("g"), "length": F.length("hit"), "digits": F.length("number"), "luhn": F.col("luhn"), "octets": F.col("octets"),
        "letters": many("[A-Za-z]"), "spaces": many(" "), "dashes": many("-"), "dots": many(r"\."), "parens": many("[()]"),
        "plus": many(r"\+"), "at": many("@"), "tail": F.length(F.regexp_extract("hit", "[A-Za-z]*$", 0)),
        "before_kind": _side(F.right(F.col("before"), F.lit(1))), "after_kind": _side(F.left(F.col("after"), F.lit(1))),
        "cue": F.col("before").rlike("(?i)mail|phone|tel|call|fax|card|visa|addr|host|contact"), "words": F.size(F.split("before", " ")),
    }
    return stored(
        known.select(
            "rid", "key", "h1", "h2", "kind", "start", "end", "base", "strict", "same", "touches",
            *(F.coalesce(shape[name].cast("double"), F.lit(0.0)).alias(f"x_{name}") for name in FEATURES),
        ),
        "candidates",
    )


def _assembled(rows: DataFrame) -> DataFrame:
    return VectorAssembler(inputCols=[f"x_{name}" for name in FEATURES], outputCol="x").transform(rows)


def fit(found: DataFrame, rows: int = FIT_ROWS) -> tuple[Model, float] | None:
    """The trees and the mean score of held-out positives; None unless both classes occur.

    At most ``rows`` loose candidates teach, drawn by a hash of their place and shape; a
    quarter of them only calibrates.
    """
    loose = found.filter("start IS NOT NULL AND NOT strict AND (same OR NOT touches)").withColumn("y", F.col("same").cast("double"))
    draw = F.pmod(F.xxhash64(F.lit("fit"), "key", "kind", "start", "end", "x_generator"), F.lit(1 << 30))
    share = min(1.0, rows / max(1, loose.count()))
    taught = loose.withColumn("draw", draw).filter(F.col("draw") < int(share * (1 << 30)))
    # A stable order in a fixed number of partitions, so that a refit gives the same trees.
    taught = taught.repartitionByRange(4, "draw", "start", "end").sortWithinPartitions("draw", "start", "end")
    taught = stored(_assembled(taught).select("x", "y", (F.col("draw") % 4 == 0).alias("held")), "taught")
    seen = {(r.held, r.y): r["count"] for r in taught.groupBy("held", "y").count().collect()}
    if not all(seen.get(k) for k in ((False, 0.0), (False, 1.0), (True, 1.0))):
        return None
    model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=15, maxDepth=4, seed=1, cacheNodeIds=False).fit(taught.filter("NOT held"))
    p = vector_to_array(F.col("probability"))[1]
    level = model.transform(taught.filter("held AND y = 1")).agg(F.avg(p)).head()[0]
    return model, level


def picked(found: DataFrame, model: tuple[Model, float] | None, least: float = 0.5) -> DataFrame:
    """``found`` with ``taken``: the base spans and the candidates that the trees take.

    A candidate that overlaps a base span of its kind adds nothing and is not taken.
    """
    if model is None:
        return found.withColumn("taken", F.col("base"))
    trees, level = model
    p = vector_to_array(F.col("probability"))[1] / F.lit(level)
    scored = trees.transform(_assembled(found))
    return scored.withColumn("taken", F.col("base") | (~F.col("strict") & ~F.col("touches") & (p >= least))).drop("x", "rawPrediction", "probability", "prediction")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``key, h1, h2, base, spans`` with arrays of ``(start, kind, end)``.

    ``kind`` is its place in KINDS; ``base`` holds the pattern's spans, ``spans`` also those
    that the trees take; both are in order and without repeats. Null and empty texts have
    none; repeated rows stay repeated; an empty table gives no rows.
    """
    found = candidates(docs, key, text)
    chosen = picked(found, fit(found))

    def ordered(which: str) -> Column:
        span = F.struct("start", "kind", "end")
        return F.array_sort(F.collect_set(F.when(F.coalesce(F.col(which), F.lit(False)), span)))

    grouped = chosen.groupBy("rid", "key", "h1", "h2").agg(ordered("base").alias("base"), ordered("taken").alias("spans"))
    return grouped.select(F.col("key").alias(key), "h1", "h2", "base", "spans")


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, the digest of the base spans, and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def text(column: str) -> Column:
        return F.array_join(F.transform(column, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ",")

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(len(KINDS))]
    return found.select(key, *counts, F.sha2(text("base").cast("binary"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets, all other columns as they are.

    Overlapping spans become one mark, that of the first. Texts without a span, and null
    ones, stay as they are.
    """
    found = spans(docs, key, text).filter("size(spans) > 0").select(
        F.col(key).alias("_key"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), F.col("spans").alias("_spans")
    )
    found = found.dropDuplicates(["_key", "_h1", "_h2"])
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64(whole) == F.col("_h1")) & (F.xxhash64(F.lit("second"), whole) == F.col("_h2"))
    marks = F.array(*(F.lit(f"[{name.upper()}]") for name in KINDS))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(state: Column, s: Column) -> Column:
        kept = F.substring(F.col(text), (state["at"] + 1).cast("int"), (s["start"] - state["at"]).cast("int"))
        fresh = F.concat(state["out"], F.array(kept, F.element_at(marks, s["kind"] + 1)))
        out = F.when(s["start"] >= state["at"], fresh).otherwise(state["out"])
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), out.alias("out"))

    def finish(state: Column) -> Column:
        rest = F.substring(F.col(text), (state["at"] + 1).cast("int"), F.length(text))
        return F.array_join(F.concat(state["out"], F.array(rest)), "")

    joined = docs.join(found, same, "left")
    clean = F.when(F.col("_spans").isNull(), F.col(text)).otherwise(F.aggregate("_spans", start, step, finish))
    return joined.withColumn("_clean", clean).select(*(F.col("_clean").alias(c) if c == text else F.col(c) for c in docs.columns))
