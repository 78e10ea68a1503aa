"""Mixing sources to target weights by pivotal dependent rounding.

A document of a source with target T and size S has a copy probability beyond the whole
copies every document gets: the fraction of T / S. The pivotal method turns these fractions
into 0 or 1 without changing their sum: two documents meet, and mass moves at random from
one to the other until one of them is integral; the other goes on with what is left.

The meetings form a reduction tree. Documents are put into cells of about ``CELL`` rows of
one source and of similar size; a cell is folded from the largest size down, so that what is
left undecided tends to be small, and leaves one document that is still fractional. These meet in the next level's cells, until a source has one,
which a last draw decides. Masses are integers (``UNIT`` is one copy), so nothing is lost on
the way, and every draw is a hash of the two documents, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from scoreloop.llm.common import WORD, stored

# Rows that meet in one cell, on average.
CELL = 256
# One whole copy, as an integer mass.
UNIT = 1 << 40
# The weights that sources take in turn, and the most copies of a document.
WEIGHTS = (5, 2, 1)
MOST = 3


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sizes`` (``source, source_size``, a row per source) with ``target``.

    Sources in the order of their code points, null last, weigh ``weights`` in turn and
    share the sum of all sizes; no target exceeds ``most`` times its source's size, and what
    is above goes to the others by weight. With sources ordered by how soon they are full,
    those that are form a prefix, so one pass over the sources (not the documents) finds it.
    """
    ranked = sizes.withColumn("_at", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_at") % len(weights) + 1).cast("int")).cast("double")
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.lit(most) * F.col("source_size").cast("double"))
    order = Window.orderBy(F.col("_cap") / F.col("_w"), "_at")
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    ranked = ranked.withColumns({
        "_left": F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)),
        "_open": F.sum("_w").over(order.rowsBetween(0, Window.unboundedFollowing)),
    })
    # The level each source sees if exactly those before it are full: the first that is not full fixes it.
    level = F.col("_left") / F.col("_open")
    ranked = ranked.withColumn("_level", F.when(level * F.col("_w") <= F.col("_cap"), level))
    shared = F.first("_level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    ranked = ranked.withColumn("target", F.least(shared * F.col("_w"), F.col("_cap")))
    return ranked.select("source", "source_size", "target")


def _draw(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _fold(items: Column, kind: str, seed: int) -> Column:
    """Fold an array of ``(size, rid, mass)``: ``held`` is still fractional, ``done`` are decided."""
    item_kind = f"struct<size:bigint,rid:{kind},mass:bigint>"
    start = F.struct(F.lit(None).cast(item_kind).alias("held"), F.array().cast(f"array<struct<rid:{kind},up:int>>").alias("done"))

    def item(old: Column, mass: Column) -> Column:
        return F.struct(old["size"].alias("size"), old["rid"].alias("rid"), mass.alias("mass"))

    def meet(state: Column, b: Column) -> Column:
        a = state["held"]
        total = a["mass"] + b["mass"]
        u = _draw(F.lit(seed), a["rid"], b["rid"])
        below = total < UNIT
        # Below one copy the one that leaves drops to 0; from one copy on it rises to 1.
        a_stays = F.when(below, u * total < a["mass"]).otherwise(u * (F.lit(2 * UNIT) - total) < F.lit(UNIT) - a["mass"])
        rest = F.when(below, total).otherwise(total - UNIT)
        left = F.struct(F.when(a_stays, b["rid"]).otherwise(a["rid"]).alias("rid"), F.when(below, 0).otherwise(1).alias("up"))
        met = F.struct(
            F.when(a_stays, item(a, rest)).otherwise(item(b, rest)).alias("held"), F.concat(state["done"], F.array(left)).alias("done")
        )
        return F.when(a.isNull(), F.struct(item(b, b["mass"]).alias("held"), state["done"].alias("done"))).otherwise(met)

    return F.aggregate(items, start, meet)


def rounded(rows: DataFrame, cell: int = CELL, seed: int = 0) -> DataFrame:
    """``(rid, up)`` for rows ``(source, size, rid, mass)``, 0 < mass < UNIT: which rise to one copy.

    Per source the number that rise differs from the sum of masses by less than one, and
    each rises with the probability of its mass. ``rid`` tells all rows apart.
    """
    kind = rows.schema["rid"].dataType.simpleString()
    # About eight classes to a doubling of the size; upper levels meet across sizes.
    rows = rows.withColumn("class", F.floor(F.log2(F.col("size").cast("double")) * 8).cast("int"))
    decided, level = [], 0
    while True:
        need = rows.groupBy("source", "class").count()
        need = need.select(F.col("source").alias("_source"), F.col("class").alias("_class"), F.ceil(F.col("count") / cell).alias("cells"))
        dealt = rows.join(need, F.col("source").eqNullSafe(F.col("_source")) & (F.col("class") == F.col("_class")))
        dealt = dealt.withColumn("cell", F.pmod(F.xxhash64(F.lit(seed + level), "rid"), F.col("cells")))
        # A cell holds about ``cell`` rows however many its source has.
        items = dealt.groupBy("source", "class", "cell").agg(F.sort_array(F.collect_list(F.struct("size", "rid", "mass")), asc=False).alias("items"))
        folded = stored(items.select("source", _fold(F.col("items"), kind, seed + level).alias("f")), "folded")
        decided.append(folded.select(F.explode("f.done").alias("d")).select("d.rid", "d.up"))
        held = folded.select("source", "f.held.size", "f.held.rid", "f.held.mass")
        decided.append(held.filter("mass = 0").select("rid", F.lit(0).alias("up")))
        rows = held.filter("mass > 0").withColumn("class", F.lit(0))
        level += 1
        if (rows.groupBy("source").count().agg(F.max("count")).head()[0] or 0) <= 1:
            break
    last = (_draw(F.lit(seed), F.col("rid")) * UNIT < F.col("mass")).cast("int")
    out = rows.select("rid", last.alias("up"))
    for more in decided:
        out = out.union(more)
    return out


def _words(text: Column) -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def _digest(source: Column, text: Column) -> Column:
    """Tells rows of one key apart; equal rows may stand for each other."""
    return F.xxhash64(source.isNull(), source, text.isNull(), text.cast("string"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ``nth``, from 1, among rows of equal ``key`` and ``h``.

    ``part`` says which task wrote a row: each part of a group numbers its own rows, on top of
    the counts of the parts before, so a group that holds a third of all rows is no single task.
    """
    local = F.row_number().over(Window.partitionBy("key", "h", "part").orderBy("h"))
    group = Window.partitionBy("key", "h").orderBy("part")
    parts = rows.groupBy("key", "h", "part").count()
    before = F.sum("count").over(group.rowsBetween(Window.unboundedPreceding, -1))
    # Most groups have one part and need no offset.
    later = parts.withColumn("before", before).filter("before IS NOT NULL")
    later = later.select(F.col("key").alias("_key"), F.col("h").alias("_h"), F.col("part").alias("_part"), "before")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")) & (F.col("part") == F.col("_part"))
    met = rows.withColumn("local", local).join(later, same, "left")
    return met.withColumn("nth", F.col("local") + F.coalesce("before", F.lit(0))).drop("local", "before", "_key", "_h", "_part")


def _copies(docs: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """``(key, h, nth, source, size, source_size, target, copies)`` for every row."""
    sized = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"), _words(F.col(text)).alias("size"),
        _digest(F.col(source), F.col(text)).alias("h"), F.spark_partition_id().alias("part"),
    )
    sized = stored(sized, "sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goals = stored(targets(totals), "targets").withColumnRenamed("source", "_source")
    rows = _numbered(sized).join(goals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "part")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    mass = F.round(share * UNIT).cast("long")
    rows = rows.withColumns({
        "whole": F.when(F.col("size") > 0, mass.bitwiseAND(-UNIT) / UNIT).otherwise(1).cast("int"),
        "mass": F.when(F.col("size") > 0, mass % UNIT).otherwise(0),
    })
    rows = stored(rows, "fractions")
    open_ = rows.filter("mass > 0").select("source", "size", F.struct("key", "h", "nth").alias("rid"), "mass")
    ups = rounded(open_, seed=seed).select(F.col("rid.key").alias("_key"), F.col("rid.h").alias("_h"), F.col("rid.nth").alias("_nth"), "up")
    same = F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h")) & (F.col("nth") == F.col("_nth"))
    taken = (F.col("whole") + F.coalesce("up", F.lit(0))).alias("copies")
    return rows.join(ups, same, "left").select("key", "h", "nth", "source", "size", "source_size", "target", taken)


def copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """``(key, occurrence, source, size, source_size, target, copies)`` for every row.

    ``size`` is the number of words of the whole text (null: 0). Rows that repeat key, source
    and text are told apart by ``occurrence``, from 1; they may stand for each other. A document
    without words is copied once; it adds nothing to any target. Very long texts are counted
    whole. Other columns do not matter, whatever their names. An empty table gives no rows.
    """
    found = _copies(docs, key, text, source, seed)
    return found.select(F.col("key").alias(key), F.col("nth").alias("occurrence"), "source", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mixed corpus: each row of ``docs`` as often as the mix takes it, all columns as they are.

    The documents are shuffled once, to meet the copies of their key, source and text. Only
    rows that repeat all three and do not all get the same copies are numbered once more.
    """
    found = _copies(docs, key, text, source, seed)
    groups = found.groupBy("key", "h").agg(F.min("copies").alias("least"), F.sum("copies").alias("total"), F.count("*").alias("n"))
    # Of the n equal rows, this many are taken once more than the others.
    groups = groups.select(F.col("key").alias("_key"), F.col("h").alias("_h"), "least", (F.col("total") - F.col("least") * F.col("n")).alias("extra"))
    groups = stored(groups, "copies")
    # The row is one column, so no name of its own columns can clash.
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    row = F.col("row")
    rows = whole.select("row", row[key].alias("key"), _digest(row[source], row[text]).alias("h"))

    def met(which: DataFrame) -> DataFrame:
        return rows.join(which, F.col("key").eqNullSafe(F.col("_key")) & (F.col("h") == F.col("_h"))).drop("_key", "_h")

    taken = met(groups.filter("extra = 0")).select("row", F.col("least").alias("copies"))
    uneven = groups.filter("extra > 0")
    if not uneven.isEmpty():
        some = _numbered(stored(met(uneven).withColumn("part", F.spark_partition_id()), "repeated"))
        taken = taken.union(some.select("row", (F.col("least") + (F.col("nth") <= F.col("extra")).cast("int")).alias("copies")))
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return taken.filter("copies > 0").select("row", each).select("row.*")
