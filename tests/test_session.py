from pyspark.sql import functions as F

from scoreloop.session import CLEANUP, stored


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_") and n.endswith(".data")}


def test_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(CLEANUP)
    sums = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).agg(F.sum("id").alias("s"))
    kept = stored(sums, "sums")
    assert shuffle_files(spark) <= before
    assert spark.conf.get(CLEANUP) == setting
    # What was stored can be stored and read again, and so can its source.
    assert sorted(stored(sums, "sums").collect()) == sorted(kept.collect()) == sorted(sums.collect())
