"""Versioned rows: isolation, replay, conflicts, compaction, clean-up."""

import time
from datetime import datetime, timedelta
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from scoreloop.sources import feature_groups as G
from scoreloop.sources.files import child_dirs, child_files, delete, publish_text, read_text
from scoreloop.sources.manifest import VersionedRows
from scoreloop.streaming.batches import query_id, without_repeats
from scoreloop.streaming.feedback import FEEDBACK_SCHEMA, LedgerSnapshot, apply_feedback_stream, read_feedback
from scoreloop.streaming.sync import sync_feedback_stream

SCHEMA = "user_id string, timestamp timestamp, value double"
SPEC = G.TableSpec("g", 1, ("user_id",), "timestamp", "date")
DAY = datetime(2024, 1, 1, 12)


def rows(spark, *values):
    """(user, day, value) rows."""
    return spark.createDataFrame([(u, DAY + timedelta(days=d), float(v)) for u, d, v in values], SCHEMA)


def held(df):
    return {(r["user_id"], r["timestamp"].day): r["value"] for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    schema = T.StructType.fromJson({"type": "struct", "fields": [
        {"name": n, "type": t, "nullable": True, "metadata": {}} for n, t in (("k", "long"), ("v", "double"), ("p", "string"))
    ]})
    return VersionedRows(spark, str(tmp_path / "t"), "p", schema, whole=("rows",))


def test_publish_never_replaces(spark, tmp_path):
    path = str(tmp_path / "m/1.json")
    assert publish_text(spark, path, "größe") and not publish_text(spark, path, "two")
    assert read_text(spark, path) == "größe"
    assert child_files(spark, str(tmp_path / "m")) == ["1.json"]
    assert [p.name for p in (tmp_path / "m").iterdir() if not p.name.endswith(".crc")] == ["1.json"]


def test_a_reader_sees_one_version(spark, tmp_path):
    root = str(tmp_path)
    G.insert(spark, root, SPEC, rows(spark, ("a", 0, 1), ("b", 0, 2)))
    before = G.read_group(spark, root, "g")
    G.insert(spark, root, SPEC, rows(spark, ("a", 0, 9), ("c", 5, 3)))
    G.compact_group(spark, root, "g")
    assert held(before) == {("a", 1): 1.0, ("b", 1): 2.0}
    assert held(G.read_group(spark, root, "g", commit=1)) == held(before)
    assert held(G.read_group(spark, root, "g", commit=2)) == held(G.read_group(spark, root, "g")) == {("a", 1): 9.0, ("b", 1): 2.0, ("c", 6): 3.0}
    assert G.group_commits(spark, root, "g") == [1, 2, 3]


def test_a_write_without_its_manifest_is_invisible(spark, store):
    store.append(spark.createDataFrame([(1, 1.0, "x")], store.schema), "rows")
    store._write(spark.createDataFrame([(2, 2.0, "x")], store.schema))  # a writer lost before the rename
    merge = lambda parts: parts["rows"]
    assert [r["k"] for r in store.read(merge).collect()] == [1]


def test_repeated_batches_change_nothing(spark, tmp_path):
    root = str(tmp_path)
    assert G.insert(spark, root, SPEC, rows(spark, ("a", 0, 1)), batch=("q", 0))
    assert G.insert(spark, root, SPEC, rows(spark, ("a", 0, 2)), batch=("q", 1))
    assert not G.insert(spark, root, SPEC, rows(spark, ("a", 0, 1)), batch=("q", 0))
    assert not G.insert(spark, root, SPEC, rows(spark, ("a", 0, 2)), batch=("q", 1))
    assert held(G.read_group(spark, root, "g")) == {("a", 1): 2.0} and G.group_commits(spark, root, "g") == [1, 2]
    assert G.insert(spark, root, SPEC, rows(spark, ("a", 0, 7)), batch=("other", 0))
    assert held(G.read_group(spark, root, "g")) == {("a", 1): 7.0}
    # An empty batch is remembered too, and shows as no rows.
    assert not G.insert(spark, root, SPEC, rows(spark).limit(0), batch=("q", 2))
    assert not G.insert(spark, root, SPEC, rows(spark, ("a", 0, 8)), batch=("q", 2))
    assert held(G.read_group(spark, root, "g")) == {("a", 1): 7.0}


def test_writers_that_meet_both_get_in(spark, store, monkeypatch):
    """A second writer publishes between the first one's look at the newest version and its rename."""
    frame = lambda k: spark.createDataFrame([(k, float(k), "x")], store.schema)
    other = VersionedRows(spark, store.path, "p", store.schema, whole=("rows",))
    look, met = store.manifest, []

    def manifest(version=None):
        found = look(version)
        if len(met) < 2:
            met.append(found.version)
            if len(met) == 2:
                other.append(frame(2), "rows")
        return found

    monkeypatch.setattr(store, "manifest", manifest)
    assert store.append(frame(1), "rows")
    assert met == [0, 0] and store.versions() == [1, 2]
    assert sorted(d.version for d in store.manifest().deltas) == [1, 2]
    assert sorted(r["k"] for r in store.read(lambda parts: parts["rows"]).collect()) == [1, 2]


def test_compaction_keeps_deltas_that_arrive_meanwhile(spark, store):
    frame = lambda k: spark.createDataFrame([(k, float(k), "x")], store.schema)
    store.append(frame(1), "rows")
    store.append(frame(2), "rows")
    merge = lambda parts: reduce(DataFrame.unionByName, parts.values())

    def late(parts):
        VersionedRows(spark, store.path, "p", store.schema).append(frame(3), "rows")
        return merge(parts)

    assert store.compact(late)
    now = store.manifest()
    assert len(now.deltas) == 1 and set(now.base) == {"p=x"}
    assert sorted(r["k"] for r in store.read(merge).collect()) == [1, 2, 3]
    assert store.compact(merge) and not store.compact(merge)
    assert sorted(r["k"] for r in store.read(merge).collect()) == [1, 2, 3]


def test_an_insert_writes_its_own_rows_only(spark, tmp_path):
    root = str(tmp_path)
    G.insert(spark, root, SPEC, rows(spark, *[(f"u{i}", i % 20, i) for i in range(2000)]))
    data = tmp_path / "g/v=1/data/rows"
    before = {p: p.stat().st_mtime_ns for p in data.rglob("*.parquet")}
    G.insert(spark, root, SPEC, rows(spark, ("u1", 1, -1)))
    after = set(data.rglob("*.parquet"))
    assert all(p in after and p.stat().st_mtime_ns == t for p, t in before.items())
    fresh = [p for p in after if p not in before]
    assert len(fresh) == 1 and spark.read.parquet(str(fresh[0])).count() == 1


def test_only_partitions_in_several_folders_are_merged(spark, tmp_path):
    root = str(tmp_path)
    G.insert(spark, root, SPEC, rows(spark, ("a", 0, 1), ("a", 1, 2), ("a", 2, 3)))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(G.read_group(spark, root, "g"))
    G.insert(spark, root, SPEC, rows(spark, ("a", 1, 5), ("b", 9, 6)))
    got = G.read_group(spark, root, "g")
    assert plan(got).count("Exchange hashpartitioning") == 1
    # A filter on the partition reaches the scans, below the merge.
    pruned = plan(got.filter("date = '2024-01-02'"))
    assert pruned.count("PartitionFilters: [isnotnull(date") == 2
    G.compact_group(spark, root, "g")
    assert "Exchange" not in plan(G.read_group(spark, root, "g"))
    assert held(G.read_group(spark, root, "g")) == {("a", 1): 1.0, ("a", 2): 5.0, ("a", 3): 3.0, ("b", 10): 6.0}


def test_compaction_after_many_inserts(spark, tmp_path):
    root, spec = str(tmp_path), G.TableSpec("b", 1, ("user_id",), None, None, buckets=3)
    for i in range(5):
        G.insert(spark, root, spec, rows(spark, ("a", i, i), (f"n{i}", 0, i)), compact_after=3)
    found = {r["user_id"]: r["value"] for r in G.read_group(spark, root, "b").collect()}
    assert found == {"a": 4.0, **{f"n{i}": float(i) for i in range(5)}}
    assert len(G.group_commits(spark, root, "b")) == 6  # five inserts and one compaction


def test_expire_keeps_what_kept_versions_need(spark, tmp_path):
    root = str(tmp_path)
    for v in (1, 2, 3):
        G.insert(spark, root, SPEC, rows(spark, ("a", 0, v)))
    G.compact_group(spark, root, "g")
    folders = f"{root}/g/v=1/data/rows"
    assert len(child_dirs(spark, folders)) == 4
    assert G.expire_group(spark, root, "g", keep=1) == 0  # too fresh: a write in progress may own them
    rows_ = G._rows(spark, root, G._stored_spec(spark, root, "g", 1))
    assert rows_.expire(1, before=int((time.time() + 60) * 1000)) == 3
    assert held(G.read_group(spark, root, "g")) == {("a", 1): 3.0} and G.group_commits(spark, root, "g") == [4]


def test_labels_that_came_with_the_log_stay(spark, tmp_path):
    """A row logged with a label keeps it over merges until a patch replaces it."""
    schema = "prediction_id string, email string, timestamp timestamp, predicted_fat_percentage double, real_fat_percentage double"
    snapshot = LedgerSnapshot(spark, str(tmp_path / "s"), buckets=2)
    snapshot.create(spark.createDataFrame([("p", "e", DAY, 10.0, 11.0), ("q", "e", DAY, 20.0, 21.0)], schema), ["timestamp"])
    snapshot.put(spark.createDataFrame([("p", "e", DAY + timedelta(days=1), 12.0)], schema.rsplit(",", 1)[0]))
    snapshot.apply(spark.createDataFrame([("q", "e", DAY, 25.0, None)], FEEDBACK_SCHEMA))
    want = {"p": (12.0, 11.0), "q": (20.0, 25.0)}
    for _ in range(2):
        assert {r["prediction_id"]: (r["predicted_fat_percentage"], r["real_fat_percentage"]) for r in snapshot.read().collect()} == want
        snapshot.compact()
    assert {r["prediction_id"]: r["real_fat_percentage"] for r in snapshot.read(1).collect()} == {"p": 11.0, "q": 21.0}


def test_sync_stream_replays_and_goes_on(spark, tmp_path):
    inbox, root, checkpoint = str(tmp_path / "in"), str(tmp_path / "root"), str(tmp_path / "cp")
    schema = "email string, timestamp string, real_fat_percentage double"

    def run():
        stream = sync_feedback_stream(spark.readStream.schema(schema).json(inbox), root, checkpoint)
        assert stream.awaitTermination(120) and stream.exception() is None

    def arrive(*values):
        spark.createDataFrame([("A@b.c", f"2024-01-0{d} 10:00:00", v) for d, v in values], schema).coalesce(1).write.mode("append").json(inbox)

    arrive((1, 20.0), (2, 21.0))
    run()
    first = G.group_commits(spark, root, "user_fat_feedback")
    for name in child_files(spark, f"{checkpoint}/commits"):
        delete(spark, f"{checkpoint}/commits/{name}")
    run()  # Spark runs the batch again
    assert G.group_commits(spark, root, "user_fat_feedback") == first
    arrive((2, 30.0), (3, 22.0))
    run()
    got = {r["timestamp"].day: r["real_fat_percentage"] for r in G.read_group(spark, root, "user_fat_feedback").collect()}
    assert got == {1: 20.0, 2: 30.0, 3: 22.0}
    assert query_id(spark, checkpoint) in G._rows(spark, root, G._stored_spec(spark, root, "user_fat_feedback", 1)).manifest().batches


def test_feedback_stream_sets_broken_and_repeated_rows_aside(spark, tmp_path):
    inbox = str(tmp_path / "in")
    rows_ = [("p", "e", DAY, 20.0, None), ("p", "e", DAY, 90.0, None), ("q", "", DAY, 30.0, None), (None, "e", DAY, 40.0, None), ("p", "e", None, 25.0, None)]
    frame = spark.createDataFrame(rows_, FEEDBACK_SCHEMA)
    frame.unionByName(frame).write.json(inbox)
    snapshot = LedgerSnapshot(spark, str(tmp_path / "s"), buckets=2)
    snapshot.create(spark.createDataFrame([], "prediction_id string, email string, timestamp timestamp, predicted_fat_percentage double"), ["timestamp"])
    stream = apply_feedback_stream(
        read_feedback(spark, inbox), snapshot, str(tmp_path / "cp"), str(tmp_path / "orphans"), str(tmp_path / "bad"), "1 day"
    )
    assert stream.awaitTermination(120) and stream.exception() is None
    assert [(r["prediction_id"], r["real_fat_percentage"]) for r in snapshot.read().collect()] == [("p", 20.0)]
    assert spark.read.parquet(str(tmp_path / "orphans")).count() == 1
    bad = spark.read.parquet(str(tmp_path / "bad")).collect()
    assert sorted((r["real_fat_percentage"], r["reasons"]) for r in bad) == [(30.0, ["email_domain"]), (90.0, ["real_fat_percentage_domain"])]


def test_repeats_across_batches(spark, tmp_path):
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "k string, t timestamp, v int"
    for v in (1, 2):
        spark.createDataFrame([("a", DAY, v), ("b", DAY + timedelta(minutes=v), v), ("c", DAY, 1)], schema).coalesce(1).write.mode("append").json(inbox)
        stream = without_repeats(spark.readStream.schema(schema).json(inbox), ["k", "t"], "t", "1 hour")
        query = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
        assert query.awaitTermination(120)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [("a", 1), ("b", 1), ("b", 2), ("c", 1)]
