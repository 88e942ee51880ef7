"""Work that follows the input: compaction sorts pieces, unread columns of change records are not computed, line pairs are joined before they are hashed."""

from pyspark.sql import functions as F

from tidemark.plans import events
from tidemark.plans.registry import Inputs
from tidemark.sources import files, lake


def plan_of(df, kind: str = "executedPlan") -> str:
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_position_of_a_change_needs_no_hashed_id(spark):
    t = Inputs(spark, "/root/testdata/sf0.001")
    assert "sha1" not in plan_of(events.source_position(t), "optimizedPlan")
    assert "sha1" in plan_of(events.change_event_id(t), "optimizedPlan")


def test_lines_are_joined_by_number(spark):
    from tidemark.plans import vault

    t = Inputs(spark, "/root/testdata/sf0.001")
    exchanges = [line for line in plan_of(vault.stored_lines(t)).splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("_hk" in line for line in exchanges)


def test_identities_are_asked_without_first_deliveries(spark, tmp_path, monkeypatch):
    from tidemark.sources.identities import IdentityStore

    store = IdentityStore(spark, str(tmp_path), ["k"])
    batch = spark.range(100).select((F.col("id") % 50).alias("k"), F.col("id").alias("src_key"))
    store.claim(store.fresh(batch, "one"), "one")
    asked, plain = [], IdentityStore.may_hold
    monkeypatch.setattr(IdentityStore, "may_hold", lambda self, rows, runs: asked.append(plan_of(rows)) or plain(self, rows, runs))
    again = batch.unionAll(spark.range(60, 63).select(F.col("id").alias("k"), F.col("id").alias("src_key")))
    assert sorted(r["k"] for r in store.fresh(again, "two").collect()) == [60, 61, 62]
    assert len(asked) == 1 and "Aggregate" not in asked[0]


def test_compaction_strings_sorted_pieces_together(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/t"
    rows = spark.range(0, 4000, 1, 16).select((F.col("id") * 7919 % 4000).alias("k"), F.col("id").cast("string").alias("v"))
    rows.unionAll(rows.limit(3)).write.parquet(f"{path}/p=1")
    before = sorted(map(tuple, spark.read.parquet(f"{path}/p=1").collect()))
    size = files.part_files(spark, f"{path}/p=1")[1]
    staged = []
    listed = files.part_paths
    monkeypatch.setattr(lake, "part_paths", lambda s, p: staged.extend(listed(s, p)) or listed(s, p))
    assert lake.compact(spark, path, {"p": 1}, ["k"], target_bytes=size // 2 + 1, piece_bytes=size // 8 + 1)[1] == 2
    assert len(staged) == 8 and max(spark.read.parquet(p).count() for p in staged) < 2000
    bounds = []
    for part in files.part_paths(spark, f"{path}/p=1"):
        keys = [r["k"] for r in spark.read.parquet(part).collect()]
        assert keys == sorted(keys)
        bounds.append((keys[0], keys[-1]))
    assert bounds[0][1] <= bounds[1][0]
    assert sorted(map(tuple, spark.read.parquet(f"{path}/p=1").collect())) == before


def test_compaction_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "k long").coalesce(1).write.parquet(f"{tmp_path}/t/p=1")
    lake.compact(spark, f"{tmp_path}/t", {"p": 1}, ["k"])
    assert spark.read.schema("k long").parquet(f"{tmp_path}/t/p=1").count() == 0


def test_logs_stay_in_as_many_partitions_as_the_input_asks_for(spark):
    from tidemark.plans import ops

    t = Inputs(spark, "/root/testdata/sf0.001")
    t.parts = 7
    assert ops.audit_log(t).rdd.getNumPartitions() == 7
