"""What several operators of this subpackage share."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scoreloop.session import stored

# Fixed value: what counts as a word, in Java's pattern syntax.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Where executors do not share that folder, ship the package with ``--py-files``.
    """
    own, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if own not in known:
        env["PYTHONPATH"] = os.pathsep.join([own, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key() -> Column:
    """A key per row of a scan, so that repeated ids do not mix."""
    return F.monotonically_increasing_id()


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links ``(src, dst)`` as ``(node, root)``.

    Every linked node is in the result once; ``root`` is some node of its
    component. Each round every node hands its links to its first neighbour in
    a hashed order (or keeps them when it comes first itself), which shrinks
    paths and stars alike: the number of rounds grows with the logarithm of
    the longest path. Each round is written to the shared folder. A hub is only
    ever the key of an aggregate with map-side combine or of a plain join,
    whose hot side adaptive execution splits.
    """

    def order(name: str) -> Column:
        return F.struct(F.xxhash64(F.col(name), F.lit("order")).alias("h"), F.col(name).alias("node"))

    def distinct(links: DataFrame) -> DataFrame:
        return (
            links.filter("src <> dst")
            .select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
            .distinct()
        )

    links = stored(distinct(edges.select("src", "dst")), "links")
    rounds: list[DataFrame] = []
    while not links.isEmpty():
        both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        parents = stored(
            both.groupBy("src").agg(F.min(order("dst")).alias("first"))
            .select(F.col("src").alias("node"), F.least("first", order("src"))["node"].alias("parent")),
            "parents",
        )
        rounds.append(parents)
        source = parents.select(F.col("node").alias("src"), F.col("parent").alias("p"))
        target = parents.select(F.col("node").alias("dst"), F.col("parent").alias("q"))
        links = stored(
            distinct(links.join(source, "src").join(target, "dst").select(F.col("p").alias("src"), F.col("q").alias("dst"))),
            "links",
        )
    if not rounds:
        return links.select(F.col("src").alias("node"), F.col("dst").alias("root"))
    roots = rounds[-1].select("node", F.col("parent").alias("root"))
    for parents in reversed(rounds[:-1]):
        above = roots.select(F.col("node").alias("parent"), "root")
        roots = parents.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("root"))
    return roots
